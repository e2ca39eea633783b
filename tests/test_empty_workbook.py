"""S2/S6 (F9, F10): a grid without rules is a workbook without sheets."""
import pytest
from conftest import rows

from ledgerlens.sources import io as IO


@pytest.mark.parametrize("data", [[], [("S1", 1), ("S2", 2)]])
def test_a_workbook_without_rows_is_read_back(spark, tmp_path, data):
    df = spark.createDataFrame(data, "sheet string, v int")
    IO.write_sheets(df, str(tmp_path / "wb"))
    book = IO.load_workbook(spark, str(tmp_path / "wb"), df.schema)
    assert book.columns == ["v", "sheet"] and rows(book, "sheet", "v") == data
    assert rows(IO.load_sheet(spark, str(tmp_path / "wb"), "S1", df.schema), "v") == [r[1:] for r in data[:1]]
