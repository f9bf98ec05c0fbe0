"""Lines with surplus, missing and quoted cells."""

import pytest

from gleaner.sources import files

TEXT = 'a,b\n1,2\n3,4,,,,bad\n5,6,,,,\n7\n8,"x,y"\n9,"q",""\n10,"l",,,"k"\n11,","\n12,"say ""hi"", all"\n13,"a"",b",,"""c"\nno,14\n'
ROWS = [(1, "2"), (5, "6"), (7, None), (8, "x,y"), (9, "q"), (11, ","), (12, 'say "hi", all'), (None, "14")]


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("sep", [",", ";", "|", "\t"])
def test_surplus_cells_at_any_place(spark, tmp_path, multi_line, sep):
    (tmp_path / "a.csv").write_text(TEXT.replace(",", sep))
    rows = files.read_csv(spark, str(tmp_path), schema="a int, b string", delimiter=sep, pattern="*.csv", multi_line=multi_line).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(a, b and b.replace(",", sep)) for a, b in ROWS], key=str)


def test_many_surplus_cells_and_line_ends(spark, tmp_path):
    wide = ",".join(["1", "2", *[""] * 500])
    (tmp_path / "a.csv").write_text(f'a,b\r\n{wide}\r\n{wide}x\r\n3,"two\nlines",,\r\n4,"two\nlines",,"x\ny"\r\n')
    rows = files.read_csv(spark, str(tmp_path), schema="a int, b string", pattern="*.csv").collect()
    assert sorted(map(tuple, rows)) == [(1, "2"), (3, "two\nlines")]
