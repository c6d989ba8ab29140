"""op1's scan of one large file: its separators are not sorted in one task."""

import re

import numpy as np

from tillroll.llm import token_scan


def test_window_rows_are_small(spark, tmp_path):
    ids = np.random.default_rng(1).integers(0, 4, 5000).astype("<u2")
    ids.tofile(tmp_path / "a.u16")
    np.array([3, 1, 3], "<u2").tofile(tmp_path / "b.u16")
    out = token_scan.scan(token_scan.files_of(spark, str(tmp_path)), str(tmp_path), end_id=3, block_ids=64)
    want = []
    for name, x in (("a.u16", ids), ("b.u16", np.array([3, 1, 3]))):
        ends = np.flatnonzero(x == 3).tolist()
        starts = [0, *(e + 1 for e in ends)]
        want += [(name, i, s, e - s, True) for i, (s, e) in enumerate(zip(starts, ends))]
        want += [(name, len(ends), starts[-1], len(x) - starts[-1], False)] if starts[-1] < len(x) else []
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*\n[^\n]*", plan)
    assert windows and all("ends" not in line for line in windows)
