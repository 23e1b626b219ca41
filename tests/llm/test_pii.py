from __future__ import annotations

import random
import re

import pytest

from lexitide.llm import pii
from tests import oracle
from tests.llm import rows

KEY = pii.TEST_KEY
P = pii.Pseudonyms(KEY)
BACK = pii.Pseudonyms(KEY, inverse=True)


def one(text, p=P):
    return pii.pseudonymise(text, p)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_a_permutation_that_inverts(size):
    got = [P.number(x, size, "t") for x in range(size)]
    assert sorted(got) == list(range(size)) and [BACK.number(y, size, "t") for y in got] == list(range(size))
    if size > 90:
        assert got != [pii.Pseudonyms(b"other").number(x, size, "t") for x in range(size)] and got != list(range(size))


@pytest.mark.parametrize(
    "kind,value",
    [
        ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("card", "378282246310005"), ("card", "3782-822463-10005"),
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ssn", "123-45-6789"), ("phone", "+1 (743) 555-3824"), ("phone", "743-555-3824"), ("phone", "+49 30 1234567"),
        ("ip", "192.168.0.1"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "1.2.2003"), ("email", "Jane.Doe99@mail.example.com"), ("email", "j" * 81 + "@example.com"), ("email", "Ab1." * 300 + "x@example.com"), ("secret", "0a9f" * 500), ("secret", "Zq7-" * 400 + "x1"), ("secret", "a1b2c3d4e5f60718"),
    ],
)
def test_formats_stay_and_values_invert(kind, value):
    lead = "token = " if kind == "secret" else "see "
    text = f"{lead}{value}, and"
    new, counts = one(text)
    assert counts[kind] == 1 and sum(counts.values()) == 1 and new != text and len(new) == len(text) or kind in ("ip", "date")
    got = new[len(lead) : -5]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", s)))
    if kind not in ("ip", "date", "secret"):
        assert shape(got) == shape(value)
    assert one(new, BACK)[0] == text
    assert one(f"{value if kind != 'secret' else 'secret: ' + value} elsewhere")[0].startswith(got if kind != "secret" else f"secret: {got}")  # equal values stay linked


def test_validity_of_pseudonyms():
    r = random.Random(4)
    for _ in range(200):
        body = "".join(r.choices("0123456789", k=15))
        number = body + str(-pii.luhn(body + "0") % 10)
        assert pii.luhn(re.sub(r"\D", "", one(f"n {number} n")[0])) == 0
    for y, m, d in [(1999, 12, 31), (2024, 2, 29), (1, 1, 1), (9999, 12, 31)]:
        new = one(f"on {y:04d}-{m:02d}-{d:02d}.")[0]
        assert re.fullmatch(r"on \d{4}-\d\d-\d\d\.", new) and pii.date(new[3:13], P)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "999.1.1.1", "2023-02-30", "000-12-3456", "a@b", "version 1.2.3", "12345", "token = short", "x192.168.0.1", "DE00 3704 0044 0532 0130 00", "1.2.3.4.5", "", "no digits here", "page 12 of 300, 1,234,567 rows"])
def test_what_is_not_valid_stays(text):
    assert one(text) == (text, dict.fromkeys(pii.KINDS, 0))


def test_linear_time_on_long_texts():
    for unit in ("1", "1 ", "12-", "+1 ", "a@", "a.", "(", "token=", "AA00 ", "1.", "@" * 3, "0-0/"):
        one(unit * (300_000 // len(unit)))


def test_long_values_take_linear_time_and_hide_every_part():
    value = "abcdefgh12" * 100_000
    new = one(f"token={value}")[0][6:]
    assert len(new) == len(value) and sum(x == y for x, y in zip(new, value, strict=True)) < 0.2 * len(value)
    assert one(f"token={new}", BACK)[0][6:] == value


def test_a_key_is_asked_for(spark):
    with pytest.raises(ValueError):
        pii.Pseudonyms(b"")
    assert pii.key_of(spark) == KEY
    spark.conf.set(pii.KEY_SETTING, "own key")
    try:
        assert pii.key_of(spark) == b"own key"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def scan(text):
    """Where values begin and end, by kind, tried at every character with patterns and checks written anew."""
    low, at, out = "abcdefghijklmnopqrstuvwxyz", 0, []
    letters = low + low.upper() + "0123456789"

    def valid_card(v):
        d = [int(c) for c in v if c.isdigit()]
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])]
        return sum(doubled) % 10 == 0

    def valid_iban(v):
        v = v.replace(" ", "")
        moved = "".join(str((low.upper().index(c) + 10) if c.isalpha() else c) for c in v[4:] + v[:4])
        return 15 <= len(v) <= 34 and int(moved) % 97 == 1 and "02" <= v[2:4] <= "98"

    def valid_date(v):
        import datetime

        n = [int(x) for x in re.findall(r"\d+", v)]
        y, m, d = n if len(re.match(r"\d+", v)[0]) == 4 else (n[2], *((n[0], n[1]) if n[1] > 12 else (n[1], n[0])))
        try:
            return bool(datetime.date(y, m, d))
        except ValueError:
            return False

    def valid_phone(v):
        code = re.match(r"(\+?\d{1,3}[ .-]?(?=\())|(\+\d{1,3}(?=[ .-]))", v)
        return 7 <= len(re.findall(r"\d", v[code.end() if code else 0 :])) <= 15

    edge = r"(?![A-Za-z0-9_])"
    numbers = [
        ("ip", rf"\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{edge}(?!\.\d)", lambda v: all(x == str(int(x)) and int(x) < 256 for x in v.split("."))),
        ("date", rf"(\d{{4}}-\d\d?-\d\d?|\d{{4}}/\d\d?/\d\d?|\d{{4}}\.\d\d?\.\d\d?|\d\d?-\d\d?-\d{{4}}|\d\d?/\d\d?/\d{{4}}|\d\d?\.\d\d?\.\d{{4}}){edge}(?![-/.]\d)", valid_date),
        ("ssn", rf"\d{{3}}-\d\d-\d{{4}}{edge}(?!-\d)", lambda v: v[:3] != "000" and v[4:6] != "00" and v[7:] != "0000"),
        ("phone", rf"(\+?\d{{1,3}}[ .-]?)?\(\d{{3}}\)[ .-]?\d{{3}}[ .-]?\d{{4}}{edge}(?!-\d)|\+\d{{1,3}}([ .-]?\d{{2,4}}){{2,4}}{edge}(?!-\d)|\d{{3}}-\d{{3}}-\d{{4}}{edge}(?!-\d)|\d{{3}}\.\d{{3}}\.\d{{4}}{edge}(?!-\d)", valid_phone),
        ("card", rf"(\d{{4}} \d{{4}} \d{{4}} \d{{1,7}}|\d{{4}}-\d{{4}}-\d{{4}}-\d{{1,7}}|\d{{4}} \d{{6}} \d{{5}}|\d{{4}}-\d{{6}}-\d{{5}}|\d{{13,19}}){edge}(?!-\d)", valid_card),
    ]
    wide = []
    for m in re.finditer(r"([A-Za-z0-9._%+-]+)@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![A-Za-z0-9-])", text):
        local = m[1].lstrip(".-+%")
        if local and m[1][-1] != ".":
            wide.append((m.start(2) - 1 - len(local), m.start(2) - 1, "email"))
    for m in re.finditer(r"(?i)(token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([a-z0-9_+/-]{16,})", text):
        if any(c.isdigit() for c in m[2]) and any(c.lower() in low for c in m[2]):
            wide.append((m.start(2), m.end(2), "secret"))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}\d\d( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", text):
        if valid_iban(m[0]):
            wide.append((m.start(), m.end(), "iban"))
    wide.sort()
    taken = [w for i, w in enumerate(wide) if not any(v[1] > w[0] for v in wide[:i])]
    gaps = list(zip([0, *(w[1] for w in taken)], [*(w[0] for w in taken), len(text)], strict=True))
    for a, b in gaps:
        at = a
        while at < b:
            before, two = (text[at - 1] if at else " "), (text[at - 2] if at > 1 else " ")
            start = re.match(r"[+(]?[0-9]", text[at:b])
            if not start:
                at += 1
                continue
            run = re.match(r"[+(]?[0-9]+", text[at:]).end()
            if before in letters or before.isalnum() or before in "_@" or (before in ".-/" and two.isdigit()):
                at += run
                continue
            for kind, pattern, ok in numbers:
                m = re.compile(pattern, re.ASCII).match(text, at, b)
                if m:
                    if ok(m[0]):
                        out.append((at, m.end(), kind))
                        at = m.end()
                    else:
                        at += run
                    break
            else:
                at += run
    return sorted(out + taken)


def test_values_are_those_that_a_plain_scanner_finds(spark):
    """Whole tables and hostile strings: what is found lies where the scanner says, and all else stays as it is."""
    r = random.Random(9)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "123-45-6789", "000-12-3456", "+1 (743) 555-3824", "743.555.3824", "10.0.0.255", "10.0.0.256", "2024-02-30", "1.2.2003", "31/12/1999", "12/31/1999", "a.b@c.org", ".x@y.de", "DE89 3704 0044 0532 0130 00", "token: abcd1234abcd1234", "secret=abcdefghijklmnop", " ", "-", ".", "x", "5", "(", "+", "@", "é", ", "]
    texts = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if x["text"]] + ["".join(r.choices(bits, k=r.randint(1, 9))) for _ in range(3000)]
    seen = dict.fromkeys(pii.KINDS, 0)
    for text in texts:
        new, counts = one(text)
        found, at, pattern = scan(text), 0, []
        for a, b, kind in found:
            pattern += [re.escape(text[at:a]), r".{5,15}" if kind in ("ip", "date") else rf".{{{b - a}}}"]
            seen[kind] += 1
            at = b
        assert counts == {k: sum(f[2] == k for f in found) for k in pii.KINDS}, text
        assert re.fullmatch("".join(pattern) + re.escape(text[at:]), new, re.S), text
    assert min(seen.values()) > 20


def test_edge_rows(spark):
    data = rows.edge_rows() + [(900 + i, f"call +1 (743) 555-3824 or mail a.b@c.org {i}", "en", "s", 1) for i in range(5)]
    df = rows.frame(spark, data, clashes=True)
    out = pii.with_pseudonyms(df, KEY)
    assert out.columns[: len(df.columns)] == df.columns
    got = sorted(((r[0], r[1]) for r in out.collect()), key=str)
    assert got == sorted(((r[0], None if r[1] is None else one(r[1])[0]) for r in data), key=str)
    back = pii.with_pseudonyms(out.select(*out.columns[:5]), KEY, inverse=True)
    assert sorted(((r[0], r[1]) for r in back.collect()), key=str) == sorted(((r[0], r[1]) for r in data), key=str)
    assert len({re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t)[0] for d, t in got if d and d >= 900}) == 1


def test_empty_table(spark):
    assert pii.with_pseudonyms(rows.frame(spark, []), KEY).count() == 0


def test_query_round_trip(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = pii.op1(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(docs)
    found = sum(sum(r[2:]) for r in out)
    assert found > 50
    changed = [r for r in out if r["text"] != docs[r["doc_id"]]]
    assert changed and all(sum(r[2:]) for r in changed)
    assert all(one(r["text"], BACK)[0] == docs[r["doc_id"]] for r in changed if not r["n_date"])
    assert oracle.DATA
