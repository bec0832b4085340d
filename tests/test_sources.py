import io
import zipfile

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.sources import files as S

A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def test_office_files(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    packed(d / "a.pptx", {f"ppt/slides/slide{n}.xml": f"<p {A}><a:t>s{n}</a:t><a:t> </a:t><a:t>x</a:t></p>" for n in (10, 2, 1)})
    p = lambda t, style="", bold=False: f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t>{t}</w:t></w:r></w:p>'
    packed(d / "b.docx", {"word/document.xml": f"<w:d {W}>{p('Intro')}{p('One', 'Heading1')}{p('body')}{p('Two', bold=True)}{p('')}</w:d>"})
    (d / "c.docx").write_bytes(b"broken")
    (d / "~$b.docx").write_bytes(b"x")
    rows = {(r.path.rsplit("/", 1)[1], r.page_no): (r.text, bool(r.error)) for r in S.document_pages(S.files(spark, str(tmp_path / "in"), S.DOCUMENTS)).collect()}
    assert rows == {
        ("a.pptx", "1"): ("s1\nx", False), ("a.pptx", "2"): ("s2\nx", False), ("a.pptx", "3"): ("s10\nx", False),
        ("b.docx", "1"): ("Intro", False), ("b.docx", "2"): ("One\nbody", False), ("b.docx", "3"): ("Two", False), ("c.docx", "1"): ("", True),
    }


def test_workbooks(spark, tmp_path):
    row = lambda n, *cells: f'<row r="{n}">{"".join(f"<c r=\"{c}{n}\" t=\"{t}\">{v}</c>" for c, t, v in cells)}</row>'
    sheet = f"<worksheet {M}><sheetData>{row(1, ('A', 's', '<v>0</v>'))}{row(2, ('A', 'inlineStr', '<is><t>k</t></is>'), ('C', 'n', '<v>7</v>'))}{row(3, ('B', 's', '<v>0</v>'))}</sheetData></worksheet>"
    packed(
        tmp_path / "w.xlsx",
        {
            "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="one" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>',
            "xl/sharedStrings.xml": f"<sst {M}><si><t>head</t></si></sst>",
            "xl/worksheets/sheet1.xml": sheet,
        },
    )
    found = S.files(spark, str(tmp_path), S.WORKBOOKS)
    assert [(r.sheet, r.row_index, r.cells) for r in S.workbook_rows(found).collect()] == [(0, 2, ["k", "", "7"])]
    assert S.workbook_rows(found, "one").first().sheet_name == "one" and S.workbook_rows(found, "two").count() == 0
    with pytest.raises(Exception, match="less than 3 sheets"):
        S.workbook_rows(found, least=3).collect()
    assert S.first_workbooks(found).count() == 1 and S.file_signatures(found).first().signature.size > 0


def test_lines_matrices_texts_and_state(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])
    (tmp_path / "x.jsonl").write_text('{"id": 1, "text": "a"}\n\n{"id": 2}\n{broken\n')
    assert S.read_json_lines(spark, str(tmp_path / "x.jsonl"), schema, strict=False).where("id IS NOT NULL").count() == 2
    S.write_json_lines(spark.createDataFrame([(1, "é")], schema), str(tmp_path / "out"))
    assert S.read_json_lines(spark, str(tmp_path / "out"), schema).first().text == "é"
    S.write_json_lines(S.read_json_lines(spark, str(tmp_path / "out"), schema).selectExpr("id + 1 AS id", "text"), str(tmp_path / "out"))
    assert S.read_json_lines(spark, str(tmp_path / "out"), schema).first().id == 2
    m = tmp_path / "m"
    m.mkdir()
    buffer = io.BytesIO()
    np.save(buffer, np.array([[3, 4], [0, 0]], np.float32))
    (m / "v.npy").write_bytes(buffer.getvalue())
    got = [[round(x, 5) for x in r.embedding] for r in S.matrix_rows(S.files(spark, str(m), ("npy",))).orderBy("row").collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]
    (m / "u.md").write_text("表格")
    (m / "g.md").write_bytes("表格".encode("gbk"))
    assert {r.text for r in S.text_files(S.files(spark, str(m), ("md",))).collect()} == {"表格"}
    assert S.read_state(spark, str(tmp_path / "none"), schema).count() == 0
    wanted = spark.createDataFrame([(1, ["no.md", "u.md", "g.md"]), (2, ["no.md"])], "wanted_id int, candidates array<string>")
    assert [(r.wanted_id, r.path.rsplit("/", 1)[1]) for r in S.resolved_files(wanted, S.files(spark, str(m), ("md",))).collect()] == [(1, "u.md")]


def test_state_follows_the_last_whole_version(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("text", StringType())])
    state = str(tmp_path / "state")
    read = lambda: sorted(tuple(r) for r in S.read_state(spark, state, schema).collect())
    S.write_state(spark.createDataFrame([(1, "a")], schema), state, 1)
    S.write_state(spark.createDataFrame([(1, "b"), (2, "c")], schema), state, 2)
    assert read() == [(1, "b"), (2, "c")]
    spark.createDataFrame([(9, "half")], schema).write.parquet(f"{state}/_writing-3")  # a job that ended before its rename
    assert read() == [(1, "b"), (2, "c")]
    S.write_state(S.read_state(spark, state, schema).where("id = 1"), state, 3)
    assert read() == [(1, "b")]
    with pytest.raises(FileExistsError):
        S.write_state(spark.createDataFrame([], schema), state, 3)
    for f in (tmp_path / "state" / "v=3").glob("part-*"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        read()


def test_presentation_tables_and_layout(spark, tmp_path):
    P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    cell = lambda t: f"<a:tc><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    box = lambda x, y, t: f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="5" cy="6"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    table = f"<a:tbl><a:tr>{cell('h')}{cell('i')}</a:tr><a:tr>{cell('1')}</a:tr></a:tbl>"
    slides = {"ppt/slides/slide1.xml": f"<p:s {P} {A}>{box(0, 0, 'over it')}<p:grpSp>{table}</p:grpSp>{table}</p:s>", "ppt/slides/slide2.xml": f"<p:s {P} {A}>{box(9, 4, 'b')}<p:grpSp>{box(1, 4, 'a')}</p:grpSp>{box(0, 9, 'c')}</p:s>"}
    packed(tmp_path / "t.pptx", slides)
    (tmp_path / "bad.pptx").write_bytes(b"broken")
    got = S.presentation_tables(S.files(spark, str(tmp_path), ("pptx",))).orderBy("page_no", "number").collect()
    assert [(r.page_no, r.kind, r.number, r.cells) for r in got[:2]] == [(1, "table", 1, [["h", "i"], ["1"]]), (1, "table", 2, [["h", "i"], ["1"]])]
    assert [line.rsplit("=", 1)[1] for line in got[2].text.split("\n")] == ["a", "b", "c"] and got[2].text.startswith("left=1 top=4 width=5 height=6") and len(got) == 3


def test_image_sizes_and_markdown_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + (200).to_bytes(2, "big") + (300).to_bytes(2, "big") + b"\3")
    (tmp_path / "c.png").write_bytes(b"none")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in S.image_sizes(S.files(spark, str(tmp_path), ("png", "jpg"))).collect()}
    assert got == {"a.png": (640, 480), "b.jpg": (300, 200), "c.png": (None, None)}
    S.write_markdown(spark.createDataFrame([("t1", "# x\n\n| a |")], "name string, text string"), str(tmp_path / "md"))
    assert next((tmp_path / "md" / "name=t1").glob("part-*")).read_text() == "# x\n\n| a |\n"
