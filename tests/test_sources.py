import base64
import io
import json
import urllib.parse
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone.sources import normalizers as n
from marlstone.sources import scan
from marlstone.sources.store import Conflict, SnapshotStore, merged


def units(name, raw, **k):
    return n.units_of("s", name, raw, **k)


def code(name, raw, **k):
    (u,) = units(name, raw, **k)
    assert u["status"] == "quarantined" and u["unit_id"] is None
    return u["code"]


def office(part, xml, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr(part, xml)
        for k, v in more.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return out.getvalue()


def test_text_and_markdown():
    assert [(u["kind"], json.loads(u["locator"])["start_line"]) for u in units("a.txt", b"one\ntwo")] == [("line", 1), ("line", 2)]
    got = units("a.md", b"---\nt: 1\n---\n# Head\n\npara\n\n```py\nx\n```\n| a | b |\n| - | - |\n")
    assert [u["kind"] for u in got] == ["frontmatter", "heading", "paragraph", "code-fence", "table"]
    assert json.loads(got[3]["structured_data"]) == {"heading": "Head", "language": "py"}


def test_csv_counts_its_header():
    (u,) = units("a.csv", b"name,count,enabled\nx,1,true\ny,2,false\n")
    d = json.loads(u["structured_data"])
    assert d["row_count"] == 3 and d["types"] == ["string", "integer", "boolean"] and u["status"] == "complete"
    (u,) = units("b.csv", b"a\n" + b"1\n" * 1500)
    assert u["status"] == "partial"
    assert code("a.csv", b"a;b", settings={"delimiter": ";;"}) == "invalid-settings"


def test_html():
    page = b"""<html lang="en"><head><title>T &amp;amp;</title></head><body><h1>H</h1><p>one <b>two</b></p><ul><li>i</li></ul>
    <table><tr><td>a</td><td>b</td></tr></table><a href="https://x.org">x</a><a href="java\tscript:evil()">y</a><script>p()</script><p></p></body></html>"""
    got = units("a.html", page)
    assert [(u["kind"], u["text"]) for u in got] == [("html-metadata", "T &amp;"), ("heading", "H"), ("paragraph", "one two"), ("list-item", "i"), ("table-row", "a | b"), ("link", "https://x.org")]
    assert json.loads(got[1]["locator"])["path"] == "/html[1]/body[1]/h1[1]"
    assert code("a.html", b"<div>" * 500 + b"x") == "limit-exceeded"
    assert code("a.html", b"") == "malformed"


def test_html_without_end_tags():
    """Paragraphs and list items that no tag ends stand side by side, however many, and aren't taken for depth."""
    got = units("a.html", b"<h1>t</h1><div>" + b"<p><b>x<br>" * 400 + b"</div><ul>" + b"<li>y" * 400 + b"<li><ul><li>z</ul></ul>")
    assert [(u["kind"], u["text"]) for u in got[1:]] == [("heading", "t")] + [("paragraph", "x")] * 400 + [("list-item", "y")] * 400 + [("list-item", "z")]
    assert [json.loads(u["locator"])["path"] for u in (got[401], got[801], got[802])] == ["/div[1]/p[400]", "/ul[1]/li[400]", "/ul[1]/li[401]/ul[1]/li[1]"]
    assert [u["text"] for u in units("a.html", b"<p>a<div><p>b</p></div>c</p>")[1:]] == ["b", "ac"]


def test_eml():
    raw = b"From: =?utf-8?q?J=C3=BCrgen?= <j@x.org>\r\nSubject: =?utf-8?b?SGVsbG8=?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>Caf=C3=A9</p><script>x</script>\r\n--b\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--b--\r\n"
    got = {u["kind"]: u for u in units("a.eml", raw)}
    assert got["email-body"]["text"] == "Café"
    assert json.loads(got["email-attachment"]["structured_data"])["byte_length"] == 3
    assert [u["text"] for u in units("a.eml", raw) if u["kind"] == "email-header"] == ["Jürgen <j@x.org>", "Hello"]


def test_office_by_content_not_by_name():
    w = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    assert [u["text"] for u in units("x.xlsx", office("word/document.xml", w))] == ["Hi", "c"]
    x = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>'
    got = units("a.xlsx", office("xl/workbook.xml", "<w/>", xl__worksheets__sheet1_dot_xml=x, xl__sharedStrings_dot_xml="<sst><si><t>S</t></si></sst>"))
    assert [u["text"] for u in got] == ["S", "2"]
    p = '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>Slide</a:t></a:r></a:p></p:sp></p:sld>'
    assert [u["text"] for u in units("a.pptx", office("ppt/presentation.xml", "<p/>", ppt__slides__slide1_dot_xml=p))] == ["Slide"]
    v = '<PageContents><Shapes><Shape ID="7"><Text>Box</Text></Shape></Shapes></PageContents>'
    assert [u["text"] for u in units("a.vsdx", office("visio/document.xml", "<v/>", visio__pages__page1_dot_xml=v))] == ["Box"]
    assert code("a.docx", office("word/document.xml", w, word__vbaProject_dot_bin="x")) == "unsafe-active-content"
    assert code("a.docx", office("word/document.xml", w, **{"word___rels__document_dot_xml_dot_rels": '<R TargetMode="External"/>'})) == "external-relationship"
    assert code("a.docx", office("word/document.xml", "<!DOCTYPE x>" + w)) == "unsafe-active-content"


def test_drawio_gif_pdf_and_limits():
    cells = '<mxGraphModel><root><mxCell id="1" value="Box"/><mxCell id="2" edge="1" source="1" target="1"/></root></mxGraphModel>'
    packed = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = base64.b64encode(packed.compress(urllib.parse.quote(cells).encode()) + packed.flush()).decode()
    for raw in (cells, f"<mxfile><diagram>{body}</diagram></mxfile>"):
        assert [u["kind"] for u in units("a.drawio", raw.encode())] == ["cell", "connector"]
    assert code("a.drawio", b'<mxfile><diagram><mxGraphModel><mxCell id="1" value="&lt;script&gt;"/></mxGraphModel></diagram></mxfile>') == "unsafe-active-content"
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff!\xf9\x04\x00\x0a\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    assert [u["kind"] for u in units("a.gif", gif)] == ["frame", "time-range"]
    assert code("misleading.txt", b"%PDF-1.7 /Encrypt %%EOF") == "encrypted"
    assert code("a.pdf", b"%PDF-1.7 /URI (x) %%EOF") == "external-relationship"
    assert code("a.pdf", b"%PDF-1.7 trunc") == "malformed"
    assert code("a.bin", b"\0") == "unsupported"
    assert code("a.txt", b"\xff\xfe") == "malformed"
    assert code("a.txt", b"x", declared_hash="sha256:0") == "source-hash-mismatch"


def test_normalize_frames_and_portable_files(spark, tmp_path):
    files = spark.createDataFrame([("1", "a.txt", bytearray(b"x\ny")), ("2", "b.bin", bytearray(b"\0")), ("3", "c.txt", None)], "source_id string, filename string, content binary")
    got = n.normalize(files)
    assert {(r.source_id, r.status, r.emitted) for r in n.manifest(got).collect()} == {("1", "complete", 2), ("2", "quarantined", 0), ("3", "complete", 1)}
    n.write_portable(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/normalized")).count() == 3
    models = spark.createDataFrame([("1", "text", '{"kind":"line-range"}', "m"), ("1", "text", '{"kind":"page"}', "m"), ("1", "text", '{"kind":"line-range"}', None)], "source_id string, format string, locator string, model string")
    allowed = spark.createDataFrame([(f, k) for f, (_, kinds) in n.FORMATS.items() for k in kinds], "format string, kind string")
    assert n.with_probabilistic(got, models, allowed).where("mode = 'probabilistic'").count() == 1


def test_scan_ledger_catalog_and_snapshot(spark, tmp_path):
    (tmp_path / "kb/a").mkdir(parents=True)
    (tmp_path / "kb/.hid").mkdir()
    (tmp_path / "kb/node_modules").mkdir()
    for p, t in {"a/x.md": "---\ntype: t\n---\nb\n", "y.md": "no front", ".hid/z.md": "z", "node_modules/q.md": "q", "r.txt": "r"}.items():
        (tmp_path / "kb" / p).write_text(t)
    found = scan.files(spark, str(tmp_path / "kb"))
    assert {r.path for r in found.collect()} == {"a/x.md", "y.md", "r.txt"}
    first = scan.ingested(found)
    assert scan.ingested(found, first).count() == 0 and scan.ingested(found, first, force=True).count() == 3
    assert {r.path: r.error is None for r in scan.concepts(found).collect()} == {"a/x.md": True, "y.md": False}
    h = {r.path: r.h for r in found.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("h")).collect()}
    catalog = spark.createDataFrame([("a/x", "a/x.md", h["a/x.md"]), ("y", "y.md", "sha256:0"), ("g", "g.md", "-"), ("u", "../u.md", "-"), ("w", "r.md", "-")], "id string, path string, byte_hash string")
    assert {(r.id, r.code) for r in scan.catalog_errors(catalog, found).collect()} == {("y", "CATALOG_HASH_MISMATCH"), ("g", "CATALOG_FILE_MISSING"), ("u", "CATALOG_PATH_UNSAFE"), ("w", "CATALOG_ID_MISMATCH")}
    before = scan.snapshot(found).first()
    (tmp_path / "kb/r.txt").write_text("changed")
    after = scan.snapshot(scan.files(spark, str(tmp_path / "kb"))).first()
    assert before.n_files == after.n_files == 3 and before.tree_hash != after.tree_hash


def test_connectors(spark):
    def answers(table):
        return lambda url: table.get(url.rpartition("!")[2] if "!" in url else url, (404, None))

    t = answers({"b/items/1": (200, {"id": "1", "eTag": "e1", "name": "a.txt", "shared": {"scope": "users"}}), "b/items/1/content": (200, b"x"), "b/items/2": (403, "secret body"), "b/files/3": (200, {"id": "3", "mimeType": "application/vnd.google-apps.document", "version": 4, "name": "d"}), "b/files/3/export": (200, b"PK")})
    got = {r.source_id: r for r in scan.acquired(spark, [("s1", lambda: scan.drive_item(t, "b", "1")), ("s2", lambda: scan.drive_item(t, "b", "2")), ("s3", lambda: scan.drive_file(t, "b", "3")), ("s4", lambda: scan.wiki_page(t, "b", "9"))]).collect()}
    assert (got["s1"].revision_kind, got["s1"].visibility, bytes(got["s1"].content)) == ("etag", "internal", b"x")
    assert got["s2"].error == "access-denied" and got["s4"].error == "not-found"
    assert got["s3"].filename == "d.docx" and got["s3"].revision_value == "4"
    assert scan.readiness({"w": ("A", "B")}, {"A": "1"}) == {"w": {"ready": False, "missing": 1}}
    d = spark.createDataFrame([("onedrive", "i", "etag", "v", "api", "2024-01-01T00:00:00Z", "sha256:" + "a" * 64, "public"), ("ftp", "", "x", "", "api", "now", "h", None)], "provider string, remote_id string, revision_kind string, revision_value string, acquired_via string, acquired_at string, content_hash string, visibility string")
    assert [r[0] for r in d.select(scan.descriptor_failures(F.struct("*"))).collect()] == [[], ["provider", "remote_id", "revision", "acquired_at", "content_hash", "access_context.visibility"]]


def test_snapshot_store(spark, tmp_path):
    s = SnapshotStore(spark, str(tmp_path / "store"))
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    assert s.commit({"t": a}, 0) == 1
    with pytest.raises(Conflict):
        s.commit({"t": a}, 0)
    b = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    s.commit({"t": merged(s.read("t"), b, ["k"], replace=True)}, 1)
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "y"), (2, "z")]
    assert sorted(map(tuple, merged(a, b, ["k"], replace=False).collect())) == [(1, "x"), (2, "z")]


def test_documents_are_spread_over_all_cores(spark):
    """One file of small rows is one partition; its documents are many tasks' work."""
    files = spark.range(100).coalesce(1).selectExpr("cast(id as string) source_id", "'a.txt' filename", "cast('x' as binary) content")
    got = n.normalize(files)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and got.count() == 100
