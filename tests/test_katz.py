from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexitide.operators import katz


def corpus(seed: int, n: int = 60):
    r = random.Random(seed)
    words = [f"{c}{i}" for i in range(12) for c in "tca"] + ["t", "c", "the", "cat"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [["<s>", *r.choices(words, weights, k=r.randint(0, 14)), "</s>"] for _ in range(n)] + [["<s>"], []]


def plain_model(posts, leave, mode="reference", cap=0.9, gamma=0.2):
    """Katz by its definition, in dictionaries; None if Good-Turing fails."""
    count = Counter(w for p in posts for w in p)
    kept = sorted(count, key=lambda w: (-count[w], [-ord(c) for c in w]))
    rare = sorted(count, key=lambda w: (count[w], [-ord(c) for c in w] + [1]))[:leave]
    vocab = set(kept) - set(rare)
    m = lambda w: w if w in vocab else "<UNK>"
    pairs = Counter((m(a), m(b)) for p in posts for a, b in zip(p, p[1:], strict=False))
    uni = Counter(m(w) for w in count.elements())
    total = sum(uni.values()) + gamma * (len(vocab) + 1)
    p_u = {w: (uni[w] + gamma) / total for w in vocab | {"<UNK>"}}
    n_r = Counter(pairs.values())
    rs = sorted(n_r)
    if len(rs) < 2:
        return None
    xs, zs = [], []
    for i, r in enumerate(rs):
        before = rs[i - 1] if i else 0
        after = rs[i + 1] if i + 1 < len(rs) else 2 * r - before
        xs.append(math.log(r))
        zs.append(math.log(2 * n_r[r] / sum(n_r.values()) / (after - before)))
    mx, mz = sum(xs) / len(xs), sum(zs) / len(zs)
    slope = sum((x - mx) * (z - mz) for x, z in zip(xs, zs, strict=True)) / sum((x - mx) ** 2 for x in xs)
    if slope > -1:
        return None
    s = lambda r: math.exp(slope * math.log(r) + mz - slope * mx)
    star, smooth = {}, False
    for r in rs:
        y = (r + 1) * s(r + 1) / s(r)
        if not smooth:
            if r + 1 not in n_r:
                return None
            x = (r + 1) * n_r[r + 1] / n_r[r]
            width = katz.quantile(0.05) * math.sqrt((r + 1) ** 2 * n_r[r + 1] / n_r[r] ** 2 * (1 + n_r[r + 1] / n_r[r]))
            smooth = abs(x - y) <= width
        star[r] = y if smooth else x
    first = defaultdict(int)
    for (a, _), n in pairs.items():
        first[a] += n
    p = {k: min(star[n] / n, cap) * n / first[k[0]] for k, n in pairs.items()}
    alpha = {}
    for w in vocab | {"<UNK>"}:
        followers = [b for a, b in pairs if a == w]
        below = sum(p_u[m(b[0])] for b in followers) if mode == "reference" else 1 - sum(p_u[b] for b in followers)
        alpha[w] = (1 - sum(p[w, b] for b in followers)) / below if followers and below else 0.1

    def entropy(post):
        bits = [math.log2(p.get((m(a), m(b)), alpha[m(a)] * p_u[m(b)])) for a, b in zip(post, post[1:], strict=False)]
        return -sum(bits) / len(bits) if bits else 0.0

    return p, alpha, p_u, entropy


@pytest.mark.parametrize("mode", ["reference", "katz"])
def test_against_dictionaries(spark, mode):
    groups = {g: corpus(g, 40 + 30 * g) for g in range(4)}
    rows = [(g, 1000 * g + i, p) for g, ps in groups.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "g int, post_id long, text array<string>")
    unseen = spark.createDataFrame([(g, -1 - g, ["<s>", "the", "zzz", "t", "</s>"]) for g in groups], "g int, post_id long, text array<string>")
    from lexitide.sources.shared import Scratch

    model = katz.fit(df, ["g"], leave_unknown=5, alpha_mode=mode, keep=Scratch(spark, "t").save)
    scored = {(r["g"], r["post_id"]): r["score"] for r in katz.entropies(df.unionByName(unseen), model).collect()}
    alphas = {(r["g"], r["w1"]): r["alpha"] for r in model.alphas.collect()}
    probs = {(r["g"], r["w1"], r["w2"]): r["p"] for r in model.bigrams.collect()}
    fitted = 0
    for g, ps in groups.items():
        want = plain_model(ps, 5, mode)
        if want is None:
            assert not any(k[0] == g for k in scored) and not any(k[0] == g for k in alphas)
            continue
        fitted += 1
        p, alpha, _, entropy = want
        assert {k[1:]: v for k, v in probs.items() if k[0] == g} == pytest.approx(p)
        assert {k[1]: v for k, v in alphas.items() if k[0] == g} == pytest.approx(alpha)
        assert {i: scored[g, 1000 * g + i] for i in range(len(ps))} == pytest.approx({i: entropy(x) for i, x in enumerate(ps)})
        if mode == "reference":
            assert scored[g, -1 - g] == pytest.approx(entropy(["<s>", "the", "zzz", "t", "</s>"]))
    assert fitted


def good_turing(spark, freq):
    df = spark.createDataFrame(list(freq.items()), "r long, n_r long").withColumn("g", F.lit(1))
    stars, groups = katz.good_turing(df, ["g"])
    return {r["r"]: round(r["c_star"], 6) for r in stars.collect()}, groups.first()


def test_good_turing_worked_example(spark):
    stars, group = good_turing(spark, {1: 120, 2: 40, 3: 24, 4: 13, 5: 9, 6: 5, 7: 4})
    assert stars == {1: 0.595208, 2: 1.476453, 3: 2.418802, 4: 3.384695, 5: 4.362146, 6: 5.346128, 7: 6.334161}
    assert round(group["slope"], 6) == -1.748534 and round(group["intercept"], 6) == -0.467943 and group["r_switch"] == 1 and group["success"]


@pytest.mark.parametrize("freq,reason", [({1: 10}, "degenerate"), ({1: 10, 2: 10, 3: 10, 4: 10}, "slope"), ({1: 900, 3: 40, 4: 20, 5: 9, 9: 1}, "gap")])
def test_good_turing_failures(spark, freq, reason):
    stars, group = good_turing(spark, freq)
    assert stars == {} and not group["success"] and group["reason"] == reason


def test_vocabulary_sizes(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1), ("e", 1)], "token string, n long").withColumn("g", F.lit(0))
    names = lambda **kw: sorted(r["token"] for r in katz.vocabulary(df, ["g"], **kw).collect())
    assert names(max_size=2) == ["a", "b"] and names(leave_unknown=1) == ["a", "b", "c", "d"] and names(leave_unknown=0.5) == ["a", "b"] and names() == ["a", "b", "c", "d", "e"]


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(corpus(3, 100))], "g int, post_id long, text array<string>")
    model = katz.fit(df, ["g"], leave_unknown=5)
    model.save(str(tmp_path / "m"))
    again = katz.Model.load(spark, str(tmp_path / "m"), ["g"])
    key = lambda m: sorted((r["post_id"], round(r["score"], 9)) for r in katz.entropies(df, m).collect())
    assert key(model) == key(again)


def test_stored_models_are_read_group_by_group(spark, tmp_path):
    texts = [f"the cat {w} on the mat . the dog {w} too ." for w in "sat ran lay sat ran sat slept ate sat ran".split()] * 6
    rows = [(g, i, t.split()) for g in ("1e5", "007", "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "run_uid string, post_id long, text array<string>")
    model = katz.fit(df, ["run_uid"], leave_unknown=2, smoothing="gt")
    model.save(str(tmp_path / "m"))
    back = katz.Model.load(spark, str(tmp_path / "m"), ["run_uid"])
    for t in katz.Model.TABLES:
        a, b = getattr(model, t), getattr(back, t)
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    one = katz.Model.load(spark, str(tmp_path / "m"), ["run_uid"], F.col("run_uid") == "007")
    assert {r[0] for r in one.bigrams.select("run_uid").distinct().collect()} == {"007"}
    assert "PartitionFilters: [isnotnull(run_uid" in one.bigrams._jdf.queryExecution().toString() and one.groups.count() == 1


def test_quantile():
    assert katz.quantile(0.05) == pytest.approx(1.959963984540054) and katz.quantile(0.01) > 2.57
