import io
import json
import zipfile
from email.message import EmailMessage

import pytest

from foliant.sources import files
from foliant.sources import formats as f


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def kinds(blocks):
    return [b["block_type"] for b in blocks]


def test_delimited():
    rows, d = f.delimited_rows("name,amount\nAlice,10\nBob,20\n")
    assert (d, len(rows)) == (",", 3) and "| Alice | 10 |" in f.delimited(b"name,amount\nAlice,10\nBob,20\n")[0]["text"]
    assert f.delimited_rows("name\tamount\nAlice\t10\n", "x.tsv") == ([["name", "amount"], ["Alice", "10"]], "\t")
    assert f.delimited_rows("\ufeffa;b;c\n\n1;2\n".removeprefix("\ufeff"))[0] == [["a", "b", "c"], ["1", "2", ""]]
    assert f.delimited(b"") == []


def test_json():
    assert f.is_json_lines('{"a": 1}\n{"a": 2}\n') and not f.is_json_lines('{"a": 1}')
    value = {"a": {str(i): "x" * 50 for i in range(100)}, "b": [1, 2]}
    parts = f.json_parts(value, 1000)
    assert len(parts) > 3 and {k for p in parts for k in p.get("a", {})} == set(value["a"]) and parts[-1]["b"] == {"0": 1, "1": 2}
    assert [json.loads(b["text"]) for b in f.json_blocks(b'{"a": 1}\nbad\n' + b'{"a": 2}\n' * 8)] == [{"a": 1}] + [{"a": 2}] * 8


def test_html_and_markdown():
    page = "<style>x{}</style><h1>Head</h1><p>one <b>two</b></p><!-- no --><ul><li>i1</li><li>i2</li></ul><table><tr><th>h</th></tr><tr><td>v</td></tr></table><script>bad()</script>"
    b = f.html_blocks(page)
    assert kinds(b) == ["title", "text", "list", "list", "table"] and b[0]["level"] == 1 and b[1]["text"] == "one two" and b[4]["rows"] == [["h"], ["v"]]
    b = f.markdown_blocks("# T\ntext\nmore\n\n- a\n- b\n> q\n```py\ncode\n\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert kinds(b) == ["title", "text", "list", "quote", "code", "table"] and b[5]["rows"] == [["a", "b"], ["1", "2"]]


def test_mail_and_rtf():
    m = EmailMessage()
    m["Subject"] = "Notice"
    m.set_content("Hello there")
    m.add_attachment(b"%PDF", maintype="application", subtype="pdf", filename="contract.pdf")
    m.add_attachment("note text", filename="notes.txt")
    b = f.eml(m.as_bytes())
    assert kinds(b) == ["title", "text", "list", "text"] and b[3]["role"] == "attachment_text" and "contract.pdf" in b[2]["text"]
    assert kinds(f.rtf(rb"{\rtf1\ansi{\fonttbl\f0 Arial;}\f0 Title here\par First one\par Second\par}")) == ["title", "text", "text"]
    assert f.msg(b"Subject: MSG Fallback Notice\nbody line\n")[0]["text"] == "MSG Fallback Notice"
    with pytest.raises(ValueError):
        f.msg(b"\xd0\xcf\x11\xe0")


def test_zipped_formats():
    w = 'xmlns:w="w"'
    odt = zipped(content_dot_xml='<r xmlns:t="t" xmlns:b="b"><t:text><t:h t:outline-level="2">H</t:h><t:p>P</t:p><t:list><t:list-item><t:p>a</t:p></t:list-item><t:list-item><t:p>b</t:p></t:list-item></t:list><b:table><b:table-row><b:table-cell>1</b:table-cell><b:table-cell>2</b:table-cell></b:table-row></b:table></t:text></r>')
    assert kinds(f.odt(odt)) == ["title", "text", "list", "table"]
    docx = zipped(**{"word__document_dot_xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:t>k</w:t></w:tc></w:tr><w:tr><w:tc><w:t>v</w:t></w:tc></w:tr></w:tbl></w:body></w:document>'})
    b = f.docx(docx)
    assert kinds(b) == ["title", "text", "table"] and b[1]["page"] == 2 and b[2]["lines"] == ["k: v"]
    shape = lambda y, t: f'<a:sp xmlns:a="a"><a:off y="{y}" x="0"/><a:p><a:pPr lvl="1"><a:buChar/></a:pPr><a:t>{t}</a:t></a:p></a:sp>'
    assert [b["text"] for b in f.pptx(zipped(**{"ppt__slides__slide1_dot_xml": f"<s>{shape(900, 'low')}{shape(10, 'high')}</s>"}))] == ["  • high", "  • low"]
    epub = zipped(**{"META-INF__container_dot_xml": '<c><rootfile full-path="o/b.opf"/></c>', "o__b_dot_opf": '<p><item id="x" href="x.html" media-type="application/xhtml+xml"/><item id="y" href="y.html" media-type="text/html"/><itemref idref="y"/><itemref idref="x"/></p>', "o__x_dot_html": "<p>second</p>", "o__y_dot_html": "<p>first</p>"})
    assert [(b["text"], b["page"]) for b in f.epub(epub)] == [("first", 1), ("second", 2)]


def test_codecs_and_types():
    assert f.decoded("中文".encode("gb18030")) == "中文" and f.decoded(b"\xef\xbb\xbfa") == "a"
    assert (f.file_type("a.B.CSV"), f.file_type("x.pdf"), f.file_type("none"), f.file_type("a.exe")) == ("csv", "pdf", None, None)


def test_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in/b.md").write_text("# T\n\nbody\n")
    (tmp_path / "c.odt").write_bytes(b"broken")
    (tmp_path / "d.exe").write_bytes(b"x")
    rows = files.blocks(spark, str(tmp_path)).collect()
    good = sorted((r.file_type, r.pos, r.block_type) for r in rows if r.error is None)
    assert good == [("csv", 0, "table"), ("md", 0, "title"), ("md", 1, "text")]
    assert {r.file_type for r in rows if r.error} == {"odt", "exe"}


def test_workbooks(spark):
    import io
    import zipfile

    from foliant.operators import sheets
    from foliant.sources.formats import xlsx

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Prices" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>pr</t></r><r><t>ice</t></r></si><si><t>tea</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>2.5</v></c></row><row r="4"><c r="A4"/></row></sheetData></worksheet>')
    want = [["name", None, "price"], [None, None, None], ["tea", "TRUE", "2.5"]]
    assert xlsx(data.getvalue()) == {"Prices": want} and xlsx(b"a,b\n1,2\n") == {"Sheet1": [["a", "b"], ["1", "2"]]}
    rows = sheets.xlsx_rows(spark.createDataFrame([("p", bytearray(data.getvalue()))], "path string, content binary"))
    assert [r.line for r in sheets.sentences(rows).collect()] == ["name：tea; TRUE; price：2.5 ——Prices"]
    assert sheets.actual_rows(rows).first().n_rows == 3
