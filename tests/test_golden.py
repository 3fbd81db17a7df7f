"""A case of our own in the wrapped line format, with expectations that follow by rule.

Two classes. Of each of ``KINDS`` dimensions class ``up`` has one shapelet; it
occurs at position 10 * dimension in the series ``ramp`` and 10 * dimension + 1 in
``step``, and is listed as absent in ``flat``. So ``ramp`` and ``step`` each give all
2^KINDS - 1 subsets, in dimension order; each matches exactly those two series,
which are the two of its class: TP 2, FN 0, FP 0, TN 1, accuracy 1. The chain of a
subset is the position of each of its dimensions in the later series, ``step``; the
literal time window starts with the smallest order as text.
"""

import os
import tempfile

from sequin.plans.queries import Mining
from sequin.sources import read_wrapped_occurrences

KINDS = 4
CLASSES = {"ramp": "up", "step": "up", "flat": "level"}


def golden_lines():
    for d in range(1, KINDS + 1):
        for t, shift in (("ramp", 0), ("step", 1), ("flat", None)):
            ix = "[]" if shift is None else f"[{10 * d + shift}]"
            yield f"(e,(rise{d};ramp;axis{d};up;{t};{ix};0.5;[1.0, 2.0];{{'{t}': 0.0}},None))"


def test_golden_sample(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sequin-golden-", dir="/tmp"), "part-00000")
    with open(path, "w") as f:
        f.write("\n".join(golden_lines()) + "\n")
    occ = read_wrapped_occurrences(spark, path)
    assert occ.count() == 3 * KINDS and occ.filter("size(ix) > 0").count() == 2 * KINDS
    dataset = spark.createDataFrame(list(CLASSES.items()), "T_name string, class_d string")
    m = Mining.from_tables(dataset, occ)
    verdicts = m.verdict_presence().collect()
    assert len(verdicts) == 2 * (2**KINDS - 1)
    assert {(v.tp, v.fn, v.fp, v.tn, v.accuracy) for v in verdicts} == {(2, 0, 0, 1, 1.0)}
    ordered = m.verdict_ordered().collect()
    assert len(ordered) == 2**KINDS - 1
    for v in ordered:
        dims = [int(i.S_name.removeprefix("rise")) for i in v["items"]]
        assert dims == sorted(dims) and list(v.tas) == [10 * d + 1 for d in dims]
        assert (v.tp, v.fn, v.fp, v.tn) == (2, 0, 0, 1)
    m.close()
