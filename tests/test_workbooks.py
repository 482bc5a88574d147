"""Workbooks made here, read as tables and as submissions."""

import zipfile

import pytest

from veriscope.plans import contract
from veriscope.sources import tables

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets, strings=(), formats=()):
    """``sheets``: name -> rows of raw cell XML bodies (attributes, inner XML)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{9 - k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"{HEAD}<workbook {NS}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{9 - k}" Target="worksheets/page{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        custom = "".join(f'<numFmt numFmtId="{165 + k}" formatCode="{f}"/>' for k, f in enumerate(formats))
        styles = '<xf numFmtId="0"/><xf numFmtId="14"/>' + "".join(f'<xf numFmtId="{165 + k}"/>' for k in range(len(formats)))
        z.writestr("xl/styles.xml", f"{HEAD}<styleSheet {NS}><numFmts>{custom}</numFmts><cellXfs>{styles}</cellXfs></styleSheet>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(f"<c {a}>{x}</c>" for a, x in row) + "</row>" for i, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/page{k}.xml", f"{HEAD}<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")


def text(v):
    return ('t="inlineStr"', f"<is><t>{v}</t></is>")


def number(v):
    return ("", f"<v>{v}</v>")


def test_kinds_of_cells(spark, tmp_path):
    rows = [
        [('r="A1" t="s"', "<v>0</v>"), ('r="B1" t="s"', "<v>1</v>"), ('r="D1" t="inlineStr"', "<is><t>when</t></is>"), ('r="E1" t="inlineStr"', "<is><t>name</t></is>")],
        [('r="A2" t="s"', "<v>2</v>"), ('r="B2"', "<v>3.5</v>"), ('r="D2" s="1"', "<v>45292</v>"), ('r="E2" t="b"', "<v>1</v>")],
        [('r="B3" t="e"', "<v>#DIV/0!</v>"), ('r="D3" s="2"', "<v>45292.75</v>"), ('r="C3" s="3"', "<v>7</v>")],
        [('r="A4"', "")],
    ]
    path = str(tmp_path / "kinds.xlsx")
    workbook(path, {"Data": rows, "Other": [[text("k")], [text("v")]]}, ["<t>name</t>", "<r><t>va</t></r><r><t>lue</t></r>", "<t>Ann &amp; Bob</t>"], ["yyyy-mm-dd hh:mm", "[Red]0.00&quot;days&quot;"])
    df = tables.spreadsheet(spark, path)
    assert df.columns == ["name", "value", "_2", "when", "name_5"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == [("Ann & Bob", "3.5", None, "2024-01-01", "true"), (None, None, "7", "2024-01-01 18:00:00", None)]
    assert [tuple(r) for r in tables.spreadsheet(spark, path, "Other").collect()] == [("v",)]
    assert tables.spreadsheet(spark, path, "none").columns == [] and tables.sheets(open(path, "rb").read())[1][0] == "Other"


def test_many_rows_and_several_workbooks(spark, tmp_path):
    for k in range(3):
        workbook(str(tmp_path / f"b{k}.xlsx"), {"S": [[text("a"), text("b")]] + [[number(i), number(k)] for i in range(40)]})
    rows = tables.workbook_rows(spark, f"{tmp_path}/*.xlsx", "S", batch=7)
    assert rows.count() == 123 and rows.where("row = 40").select("cells").distinct().count() == 3
    df = tables.spreadsheet(spark, f"{tmp_path}/*.xlsx", "S")
    assert df.count() == 120 and df.where("b = '2'").count() == 40


def test_a_submission_in_a_workbook(spark, tmp_path):
    path = str(tmp_path / "claims.xlsx")
    head = [text(c) for c in ("subject_id", "y_true", " y_pred ", "device")]
    workbook(path, {"Claims": [head] + [[text(f"s{i % 9}"), number(10 + i % 5), number(10.5 + i % 4), text("one")] for i in range(60)]})
    frame = contract.load(path, spark)
    assert frame.df.count() == 60 and frame.df.selectExpr("avg(y_pred)").first()[0] == pytest.approx(12.0)
    with pytest.raises(contract.ContractError):
        empty = str(tmp_path / "empty.xlsx")
        workbook(empty, {"Claims": [head]})
        contract.load(empty, spark)
