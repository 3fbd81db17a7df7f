"""Text readers: `;`-separated, positional, no header, no quoting."""

import os
import tempfile

import pytest

from sequin.sources import accepted, read_dataset, read_occurrences, read_wrapped_occurrences, rejected, write_wrapped_occurrences


def _write(lines):
    folder = tempfile.mkdtemp(prefix="sequin-text-", dir="/tmp")
    path = os.path.join(folder, "part-00000")
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_dataset_reader(spark):
    rows = read_dataset(spark, _write(["a_01.csv;normal", "b_02.csv;abnormal"])).orderBy("T_name").collect()
    assert [(r.T_name, r.class_d) for r in rows] == [("a_01.csv", "normal"), ("b_02.csv", "abnormal")]


GOOD = "s1;a_01.csv;11;normal;b_02.csv;[0, 5];0.25;[2.0, 1.5];{'a_01.csv': 0.0, 'b_02.csv': 3.5}"


def test_occurrence_reader_types(spark):
    lines = [GOOD, "s1;a_01.csv;11;normal;a_01.csv;[];0;[];{}", "s1;a_01.csv;11;normal;c.csv;[3000000000];0;[];{}"]
    rows = {(r.S_name, r.T_name): r for r in read_occurrences(spark, _write(lines)).collect()}
    r = rows[("s1", "b_02.csv")]
    assert r.ix == [0, 5] and r.gain == 0.25 and r.sub_sequence == [2.0, 1.5]
    assert r.distance == {"a_01.csv": 0.0, "b_02.csv": 3.5}
    assert rows[("s1", "a_01.csv")].ix == [] and rows[("s1", "c.csv")].ix == [3000000000]


@pytest.mark.parametrize("bad", ["[0, x]", "[0.5]", "nan", "", "[99999999999999999999]"])
def test_an_unreadable_list_is_an_error_that_shows_it(spark, bad):
    path = _write([GOOD, f"s1;a_01.csv;11;normal;c.csv;{bad};0;[];{{}}"])
    with pytest.raises(Exception, match="unreadable position list"):
        read_occurrences(spark, path).collect()


def test_a_short_line_is_an_error_that_shows_it(spark):
    with pytest.raises(Exception, match="fewer than 9 fields in line: s2;a_01.csv;12"):
        read_occurrences(spark, _write([GOOD, "s2;a_01.csv;12"])).collect()
    with pytest.raises(Exception, match="fewer than 2 fields in line: lonely"):
        read_dataset(spark, _write(["a;b", "lonely"])).collect()


# one field of GOOD spoilt: its place, its text, what the reject says
SPOILT = [
    (5, "[0, x]", "unreadable position list: [0, x]"),
    (5, "", "unreadable position list: "),
    (6, "high", "unreadable gain: high"),
    (6, "", "unreadable gain: "),
    (7, "[1.0, y]", "unreadable value list: [1.0, y]"),
    (7, "2.0", "unreadable value list: 2.0"),
    (7, "[1.0, null]", "unreadable value list: [1.0, null]"),
    (8, "{oops}", "unreadable distances: {oops}"),
    (8, "{'a': null}", "unreadable distances: {'a': null}"),
]


def _spoil(place, text):
    fields = GOOD.split(";")
    fields[place] = text
    return ";".join(fields)


@pytest.mark.parametrize("wrap", [False, True])
def test_bad_lines_are_reported(spark, wrap):
    lines = [GOOD, "s2;a_01.csv;12", *[_spoil(p, t) for p, t, _ in SPOILT], _spoil(6, "1e-3") + ";extra field"]
    if wrap:
        lines = [f"(e,({x},None))" for x in lines] + [GOOD, "(e,(cut"]
    read = (read_wrapped_occurrences if wrap else read_occurrences)(spark, _write(lines), bad="report")
    good = accepted(read).collect()
    assert sorted(r.gain for r in good) == [0.001, 0.25] and all(r.ix == [0, 5] for r in good)
    bad = {r.line: r for r in rejected(read).collect()}
    form = (lambda x: f"(e,({x},None))") if wrap else (lambda x: x)
    want = {form(_spoil(p, t)): w for p, t, w in SPOILT}
    want[form("s2;a_01.csv;12")] = f"fewer than 9 fields in line: {form('s2;a_01.csv;12')}"
    if wrap:
        want |= {x: f"no wrapped record in line: {x}" for x in (GOOD, "(e,(cut")}
    assert {k: r.reject for k, r in bad.items()} == want
    assert all("sequin-text-" in r.file for r in bad.values())


@pytest.mark.parametrize("place,text,message", SPOILT)
def test_bad_fields_fail_by_default(spark, place, text, message):
    path = _write([GOOD, _spoil(place, text)])
    with pytest.raises(Exception, match="unreadable"):
        read_occurrences(spark, path).collect()
    # a field that is not used is not parsed
    assert read_occurrences(spark, path).select("S_name", "T_name").count() == 2


def test_an_unwrapped_line_is_an_error_that_shows_it(spark):
    with pytest.raises(Exception, match="no wrapped record in line: s1;a_01"):
        read_wrapped_occurrences(spark, _write([GOOD])).collect()


def test_bad_catalogue_lines_are_reported(spark):
    read = read_dataset(spark, _write(["a;b", "lonely"]), bad="report")
    assert [tuple(r) for r in accepted(read).collect()] == [("a", "b")]
    assert [(r.line, r.reject) for r in rejected(read).collect()] == [("lonely", "fewer than 2 fields in line: lonely")]
    with pytest.raises(ValueError):
        read_dataset(spark, "/none", bad="skip")


def test_wrapped_text_comes_back(spark, tmp_path):
    occ = read_occurrences(spark, _write([GOOD, "name2;o;d;c;t;[];1.5;[];{}"]))
    write_wrapped_occurrences(occ, f"file://{tmp_path}/out")
    lines = {x for f in os.listdir(tmp_path / "out") if f.startswith("part") for x in open(tmp_path / "out" / f).read().splitlines()}
    assert {x[:4] for x in lines} == {f"({GOOD[4]},(", "(2,("} and all(x.endswith(",None))") for x in lines)
    back = read_wrapped_occurrences(spark, f"file://{tmp_path}/out")
    assert sorted(map(str, back.collect())) == sorted(map(str, occ.collect()))
