from __future__ import annotations

import hashlib
import re
import zlib
from html import unescape

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import html_extraction as hx
from ledgerline.llm import media_columns as mc
from ledgerline.llm import url_filter as uf


def test_media_round_trip(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = mc.op4_media_columns(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        payload = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 or (64 if not texts[r.doc_id] else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_media_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "y" * 65), (4, "y" * 65), (None, "z"), (5, "한" * 200_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(b"clash"))
    found = mc.media_columns(frame).collect()
    assert sorted((r.doc_id or 0, r.payload_bytes) for r in found) == [(0, 64), (1, 64), (2, 64), (3, 64), (4, 128), (4, 128), (5, 600_000)]
    same = {r.feature for r in found if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert mc.media_columns(frame.where("false")).count() == 0


def test_ranges_and_retries(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, "t" * (i * 7)) for i in range(200)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/m"
    mc.store(frame, path)
    small = spark.read.format("media_archive").option("path", path).option("range_bytes", 3000).load()
    assert small.rdd.getNumPartitions() > 5 and small.select("doc_id").distinct().count() == 200
    reader = mc._Reader(path, 1 << 30)
    files, place = mc.fs.FileSystem.from_uri(path)
    (part,) = reader.partitions()

    class Flaky:
        """Gives wrong bytes once for one member."""

        def __init__(self, files):
            self.files, self.opened = files, 0

        def open_input_file(self, p):
            self.opened += 1
            inner = self.files.open_input_file(p)
            if self.opened > 1:
                return inner
            outer = self

            class File:
                reads = 0

                def seek(self, at):
                    inner.seek(at)

                def read(self, n):
                    self.reads += 1
                    return b"?" * n if self.reads == 6 else inner.read(n)

                def close(self):
                    inner.close()

            return File()

    with files.open_input_file(f"{place}/{part.archive}") as f:
        members = mc.zipfile.ZipFile(f).infolist()
    flaky = Flaky(files)
    assert len(list(reader._stream(flaky, f"{place}/{part.archive}", members))) == 200 and flaky.opened == 2


URLS = [
    ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://b.example.net/de/1#y", "b.example.net", "/de/1", "net/", "block"),
    ("https://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("https://q.example.org/fr/9", "q.example.org", "/fr/9", "org/fr/", "allow"),
    ("https://free-casino.example.org/en/2", "free-casino.example.org", "/en/2", None, "block"),
    ("https://blog.therion.example.com/en/2", "blog.therion.example.com", "/en/2", None, "allow"),
    ("http://net?x", "net", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    found = uf.filter_urls(frame).orderBy("page_id").collect()
    for r, (_, host, path, rule, verdict) in zip(found, URLS, strict=True):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert uf.filter_urls(frame.where("false")).count() == 0


@pytest.mark.parametrize(
    ("held_back", "least"),
    [
        (lambda k, url: zlib.crc32(url[0].encode()) % 5 == 0, 0.97),  # measured: 1.0
        (lambda k, url: k % 5 == 0, 0.9),  # every fifth word is never seen in second place; measured: 0.925
    ],
)
def test_url_model_on_held_back_rows(held_back, least):
    import pyarrow as pa

    urls = uf.labelled_urls()
    model = uf.fit([u for k, u in enumerate(urls) if not held_back(k, u)])
    hosts, paths, labels = zip(*(u for k, u in enumerate(urls) if held_back(k, u)), strict=True)
    scores = model.score(pa.array(hosts), pa.array(paths))
    assert sum((s >= 0.5) == bool(y) for s, y in zip(scores, labels, strict=True)) / len(labels) > least


def test_main_text_of_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()}
    for r in hx.op9_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?p>|</?h1>|<br>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_pages():
    chain = hx.train()
    wrong = total = 0
    for page, labels in hx.labelled_pages(150, seed=99):
        wrong += sum(a != b for a, b in zip(chain.decode(hx.leaf_blocks(page)), labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.02


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("<p>a<p>b &amp;amp; c", ["a", "b &amp; c"]),
        ("<ul><li>a<li>b <b>x</i>y</b></ul>", ["a", "b xy"]),
        ("<script>if (a<b) {}</script><style>p{}</style><!-- c -->t<br>u <", ["t u <"]),
        ("<div>a<div>b</p></div>c</div", ["a", "b", "c"]),
        ("<p title='a>b'>x&nbsp;&#233;\n y</p>", ["x é y"]),
        ("<title>t</title><textarea>x</textarea>z", ["z"]),
    ],
)
def test_leaf_blocks(page, texts):
    assert [b.text for b in hx.leaf_blocks(page)] == texts


def test_page_edges(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<article><h1>T</h1><p>Some words here, and there.</p></article>")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = hx.extract(frame).collect()
    assert sorted((r.page_id or 0, r.text) for r in found) == [(0, "T\nSome words here, and there."), (1, ""), (2, ""), (2, "")]
    assert hx.extract(frame.where("false")).count() == 0
