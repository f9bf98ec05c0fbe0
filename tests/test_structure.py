"""Structure operators: nothing leaves the row, and results equal those of plain loops over lines."""

import random
import re
import time

import pytest

from gleaner.operators import structure

OPERATORS = [
    structure.headings, structure.sections, structure.structure_summary, structure.table_islands, structure.table_lines,
    structure.split_table_cells, structure.aligned_table_cells,
]
PIECES = [
    "", "", "   ", "a  b   c", "x   yy  z", "long word   1  2", "a | b | c", "|--|--|", "1\t2\t3", "plain words here", "---+---", "TITLE", "# mark",
    "\xa0", "p  q", "é  ü   ñ", "| only | two |", " lead   and  trail  ",
]


def texts(seed, n=60):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def plain_tables(text):
    """Runs of rows, rulers and blank lines as (first line number, lines)."""
    opens = lambda s: bool(re.fullmatch(r"[\s\-+|]+", s) or s.count("|") > 1 or s.count("\t") > 1 or (re.search(r"\s{2,}\S", s) and re.search(r"\S\s{2,}", s)))
    out, run = [], []
    for i, line in enumerate([*text.split("\n"), "end of text"]):
        if opens(line) or (run and not line.strip()):
            run.append((i, line))
        elif run or line.strip():
            if sum(bool(s.strip()) for _, s in run) >= 2:
                out.append(run)
            run = []
    return out


def plain_aligned(lines):
    breaks = []
    for line in lines[:5]:
        found = [m.start() for m in re.finditer(r"\s{2,}", line)]
        breaks = [b for b in breaks if any(abs(b - f) <= 1 for f in found)] if breaks else found
    rows = []
    for n, line in enumerate(lines):
        cuts = [0, *(b for b in breaks if n == 0 or b < len(line))]
        cells = [line[a:b].strip() for a, b in zip(cuts, cuts[1:])]
        rows.append(cells + [""] * (len(breaks) - len(cells)) + [line[cuts[-1]:].strip()])
    return rows if breaks and len(rows) > 1 else []


def test_tables_equal_plain_loops(spark):
    data = texts(1) + texts(2)
    df = spark.createDataFrame(list(enumerate(data)), "id int, text string")
    got = {}
    for r in structure.table_lines(df, "id", "text").orderBy("id", "line_no").collect():
        got.setdefault((r["id"], r["table_no"]), []).append((r["line_no"], r["raw"]))
    assert got == {(i, t): run for i, text in enumerate(data) for t, run in enumerate(plain_tables(text))}


def test_aligned_cells_equal_plain_loops(spark):
    data = texts(3) + texts(4)
    df = spark.createDataFrame(list(enumerate(data)), "id int, text string")
    got = {(r["id"], r["table_no"], r["row_no"], r["col_no"]): r["cell"] for r in structure.aligned_table_cells(df, "id", "text").collect()}
    want = {}
    for i, text in enumerate(data):
        for t, run in enumerate(plain_tables(text)):
            if run[0][1].count("|") > 1 or run[0][1].count("\t") > 1:
                continue
            for r, cells in enumerate(plain_aligned([s for _, s in run if s.strip()])):
                want |= {(i, t, r, c): cell for c, cell in enumerate(cells)}
    assert want and got == want


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_rows_stay_where_they_are(spark, operator):
    df = spark.createDataFrame([(1, "A\n\nb"), (2, None), (3, ""), (3, "T\n\nx")], "id int, text string")
    plan = operator(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange|Window|Python|Arrow|Sort", plan)


def test_null_empty_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A\nb"), (3, "C\nd")], "id int, text string")
    summary = sorted(tuple(r) for r in structure.structure_summary(df, "id", "text").collect())
    assert summary == [(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 1, 1, 1, False), (3, 1, 1, 1, False)]
    assert sorted((r["id"], r["title"], r["content"]) for r in structure.sections(df, "id", "text").collect()) == [(3, "A", "b"), (3, "C", "d")]


def test_long_text(spark):
    """Fifty thousand lines: sections and tables in seconds, not with the square."""
    lines = 50_000
    text = "\n".join(("HEAD %d" % i) if i % 5 == 0 else ("a  b  c" if i % 5 < 3 else "some words") for i in range(lines))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    start = time.time()
    assert structure.sections(df, "id", "text").count() == lines // 5
    assert structure.table_islands(df, "id", "text").count() == lines // 5
    assert time.time() - start < 30
