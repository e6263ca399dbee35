"""Tree listings: one pattern a line, the same rows as the pattern over the whole line."""

import re

from riskspark.sources.repo import parse_manifest

ID, LONG = "0123456789abcdef" * 2 + "01234567", "0123456789abcdef" * 4
WHOLE = re.compile(r"^(\d{6}) (blob|commit|tree) ([0-9a-f]{40}|[0-9a-f]{64}) +(\d+|-)\t([\s\S]+)\Z", re.ASCII)
LINES = [
    f"100644 blob {ID} 12\tsrc/a.txt", f"100644 blob {LONG}      7\ta b\tc\n", f"160000 commit {ID} -\tsub", f"100644 blob {ID} 12\t",
    f"100644 blob {ID} 12 src/a.txt", f"100644 blob {ID}12\tx", f"100644  blob {ID} 12\tx", f"100644 blob {ID}a 12\tx", f"100644 blob {ID}\t12\tx",
    f"100644 blob {ID} {'9' * 30}\tx", f"\n100644 blob {ID} 1\tx", f"100644 blob {ID} 1\n\tx", f"100644 blob {ID} 1\t\t", "\t", "x", "", None,
]


def test_lines_are_parsed_as_by_one_pattern(spark):
    good, bad = parse_manifest(spark.createDataFrame([(x,) for x in LINES], "value string"))
    want = [m.groups() for m in (WHOLE.match(x) for x in LINES if x) if m]
    want = [(a, b, c, int(d) if d.isdigit() and int(d) < 2**63 else None, e) for a, b, c, d, e in want]
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(r.entry for r in bad.collect()) == sorted(x for x in LINES if x and not WHOLE.match(x))


def test_no_pattern_is_matched_for_each_part(spark):
    good, _bad = parse_manifest(spark.createDataFrame([(LINES[0],)], "value string"))
    assert "regexp_extract" not in good._jdf.queryExecution().optimizedPlan().toString()
