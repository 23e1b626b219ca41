"""DataFrame-to-DataFrame operators: cleaning, timelines, sampling, language models, trajectories."""
