"""PDF and Word files, several kinds at once, typed tables of sheets, chunks of pages."""

import zipfile
import zlib

from lodestone.operators.chunking import windows
from lodestone.sources import ingest, pdf, readers


def pdf_file(pages, packed=True, maps=""):
    """A small file of one content stream a page; kids are listed in another order than the objects."""
    n = len(pages)
    parts = ["1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", f"2 0 obj << /Type /Pages /Count {n} /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(n))}] /Resources << /Font << /F1 5 0 R >> >> >> endobj"]
    parts.append("5 0 obj << /Type /Font /BaseFont /X " + ("/ToUnicode 6 0 R" if maps else "") + " >> endobj")
    out = ["%PDF-1.4\n".encode(), "\n".join(parts).encode() + b"\n"]
    if maps:
        out.append(b"6 0 obj << /Length 1 >>\nstream\n" + maps.encode() + b"\nendstream endobj\n")
    for k in reversed(range(n)):
        body = pages[k].encode("latin-1")
        data = zlib.compress(body) if packed else body
        out.append(f"{10 + 2 * k} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >> endobj\n{11 + 2 * k} 0 obj << {'/Filter /FlateDecode' if packed else ''} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream endobj\n")
    return b"".join(out) + b"%%EOF"


def test_pdf_pages():
    one = r"BT /F1 12 Tf 10 700 Td (Hello \(big\) ) Tj [(wor) -20 (ld) -300 (again)] TJ 0 -14 Td (caf\351) Tj T* (end) ' ET"
    two = "BT 1 0 0 1 50 700 Tm (left) Tj 1 0 0 1 90 700 Tm (right) Tj ET"
    want = ["Hello (big) world again\ncafé\nend", "left right"]
    assert pdf.pdf_pages(pdf_file([one, two])) == want == pdf.pdf_pages(pdf_file([one, two], packed=False))
    mapped = pdf_file(["BT /F1 9 Tf <00010002> Tj ET"], maps="1 beginbfchar <0001> <0633> endbfchar 1 beginbfrange <0002> <0004> <0644> endbfrange")
    assert pdf.pdf_pages(mapped) == ["سل"]
    assert pdf.pdf_pages(b"") == [] == pdf.pdf_pages(b"no file") and pdf.pdf_pages(b"%PDF-1.4 broken") == []
    assert pdf.pdf_pages(pdf_file(["BT 1 . Td (x) Tj ET"])) == ["x"] and pdf.pdf_pages(pdf_file([""])) == [""]


def test_read_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf_file(["BT (one) Tj ET", "BT (two) Tj ET"]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    assert sorted((r["page"], r["text"]) for r in pdf.read_pdf_pages(spark, str(tmp_path)).collect()) == [(0, "one"), (1, "two")]
    assert sorted(r["text"] for r in readers.read_files(spark, str(tmp_path), ["pdf"]).collect()) == ["", "one\n\ntwo"]


def test_word_tables_and_headings(tmp_path):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Top", '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>') + p("text") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('')}</w:tr></w:tbl>" + p("end")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    assert readers.docx_text((tmp_path / "x.docx").read_bytes()) == "## Top\n\ntext\n\na | b\n1 | \n\nend"


def sheet(path, *sheets):
    n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        for k, rows in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {n}>" + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{c}</t></is></c>' for c in r) + "</row>" for r in rows) + "</worksheet>")


def test_sheets_are_typed_tables(spark, tmp_path):
    sheet(tmp_path / "Big Book.xlsx", [["id", "price", "name", "", "Name"], ["1", "2.5", "x", "true", "9"], ["2", "3", "", "false"]], [["only head"]])
    (tmp_path / "bad.xlsx").write_bytes(b"broken")
    tables = ingest.sheet_tables(spark, str(tmp_path))
    (name, frame), = tables.items()
    assert name == "big_book_sheet1" and frame.dtypes == [("id", "bigint"), ("price", "double"), ("name", "string"), ("column_4", "boolean"), ("Name_5", "bigint")]
    assert sorted(map(tuple, frame.collect())) == [(1, 2.5, "x", True, 9), (2, 3.0, None, False, None)]


def test_ingest_of_several_kinds(spark, tmp_path):
    text = "word " * 500
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.md").write_text("# Head\n\nbody")
    (tmp_path / "c.pdf").write_bytes(pdf_file(["BT (page) Tj ET"]))
    chunks = ingest.ingest(spark, str(tmp_path), ["txt", "md", "pdf"], size=300, overlap=50, extra={"by": "me"})
    got = {(r["kind"], r["chunk_index"], r["n_chunks"], r["chunk"]) for r in chunks.collect()}
    pieces = [c for _, c in windows(text, 300, 50)]
    assert got == {("txt", k, len(pieces), c) for k, c in enumerate(pieces)} | {("md", 0, 1, "Head\n\nbody"), ("pdf", 0, 1, "page")}
    assert chunks.first()["metadata"]["by"] == "me" and {r["kind"]: r["chunks"] for r in ingest.file_statistics(chunks).collect()} == {"txt": len(pieces), "md": 1, "pdf": 1}


def test_page_chunks_and_markdown(spark):
    rows = [("u1", "alpha beta. " * 200), ("u2", None), ("u3", " "), ("u4", "kurz")]
    got = ingest.page_chunks(spark.createDataFrame(rows, "url string, body string"), "url", "body", size=200, overlap=20).collect()
    want = {(u, k, c) for u, t in rows if t and t.strip() for k, (_, c) in enumerate(windows(t, 200, 20))}
    assert {(r["url"], r["chunk_index"], r["chunk"]) for r in got} == want and all(r["n_chars"] == len(r["chunk"]) for r in got)
    docs = spark.createDataFrame([(1, "too short"), (2, "A sentence of some length here. " * 40), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in ingest.markdown_chunks(docs, "doc_id", "text").collect()} == {2}
