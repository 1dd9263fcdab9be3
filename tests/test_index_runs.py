"""An index is built from runs of postings, a bounded number of tokens at a time."""

from collections import Counter

import numpy as np

from lodestone.operators import text_index


def test_runs_are_cut_by_tokens_and_hold_all(spark, monkeypatch):
    monkeypatch.setattr(text_index, "SLICE", 20)
    rows = [(k, [f"w{k % 3}", "all", "all", f"x{k}"]) for k in range(60)] + [(100, ["all"] * 90), (101, []), (102, None)]
    runs = text_index._counted(spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1)).collect()
    got = {}
    for r in runs:
        for i, tf, size in np.frombuffer(r.data, text_index._POSTING).tolist():
            assert (r.token, i) not in got
            got[r.token, i] = (tf, size)
    want = {(t, i): (n, len(tokens)) for i, tokens in rows if tokens for t, n in Counter(tokens).items()}
    want |= {(None, i): (0, len(tokens or [])) for i, tokens in rows}
    assert got == want
    assert max(sum(len(r.data) // 16 for r in runs if r.token == t) for t in ("w1",)) == 20 and sum(r.token == "all" for r in runs) > 10
