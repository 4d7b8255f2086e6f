import math
import zlib

import numpy as np

from carrel.llm import langid as li
from tests.conftest import SMALL

FOLDER = SMALL.replace("0.001", "0.01")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = li.train(docs)
    rows = li.identify(None, docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r.language == r.lang for r in held) / len(held) > 0.97


def test_evidence_is_fused(spark):
    """Where the text says nothing, the declaration decides, and then the host."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = li.train(docs)
    text = {r.lang: r.text[:600] for r in docs.where("length(text) > 600").collect()}
    page = lambda lang, body: f'<html lang="{lang}"><body><p>{body}</p></body></html>'
    rows = [(i, "http://fr.example.fr/x", page("fr", text["fr"])) for i in range(30)] + [(30 + i, "http://de.example.de/x", page("de", text["de"])) for i in range(30)]
    rows += [(100, "http://other.example.org/x", page("fr", "")), (101, "http://de.example.de/y", "<html><body></body></html>"), (102, "http://new.example.fr/", ""), (103, None, None)]
    got = {r.page_id: r for r in li.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), None, model).collect()}
    assert [got[k].language for k in (0, 30, 100, 101, 102)] == ["fr", "de", "fr", "de", "fr"]
    assert len(got) == len(rows) and all(0 < r.confidence <= 1 for r in got.values())


def test_oddities(spark, docs, empty):
    model = li.train(docs)
    assert li.identify(None, docs, model).count() == docs.count() and li.identify(None, empty, model).count() == 0
    nothing = li.train(empty)
    assert {r.language for r in li.identify(None, docs, nothing).collect()} == {"und"}


def test_counts_cover_whole_texts():
    assert len(li.trigrams("ab" * 100_000)) == 200_000
    assert (li.trigrams("A  b") == li.trigrams("a, b")).all()
    assert li.page_text("<p>a &amp; b<script>x</script><!-- c --></p>").split() == ["a", "&", "b"]


def test_any_number_of_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}q{chr(97 + i // 26)} " * 20, f"x{i:03d}", f"s{i % 3}") for i in range(2 * 230) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = li.train(docs)
    assert len(model.languages) == len(rows) > 200 and model.log.size <= li.CELLS
    out = li.identify(None, docs, model).collect()
    assert len(out) == len(rows) and sum(r.language == f"x{r.doc_id:03d}" for r in out) > 0.9 * len(rows)


def test_posteriors_against_counting(spark, monkeypatch):
    """The fused posteriors of a small table, worked out one by one, on either side of the broadcast bound."""
    from carrel.llm import common

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    model = li.train(docs)
    lang = model.languages
    rows = [(i, f"http://h{i % 4}.example.{'de' if i % 3 else 'fr'}/", f'<html lang="{lang[i % len(lang)]}"><p>{r.text[:200]}</p>') for i, r in enumerate(docs.collect())] + [(100, None, None), (101, "http://h1.example.de/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    facts = []
    for i, url, page in rows:
        like = model.likelihood(li.page_text(page))
        host = url.split("/")[2] if url else ""
        said = page.split('"')[1] if page else None
        facts.append((i, host, host.rsplit(".", 1)[-1], said, like, li._normalised(like, model.prior)))
    total = sum(f[5] for f in facts) + 1
    want = {}
    for i, host, suffix, said, like, own in facts:
        others = lambda k, v: [f[5] for f in facts if f[k] == v]
        s, h, d = others(2, suffix), others(1, host), others(3, said)
        of_suffix = (sum(s) - own + li.SMOOTH * total / total.sum()) / (len(s) - 1 + li.SMOOTH)
        of_host = (sum(h) - own + li.SMOOTH * of_suffix) / (len(h) - 1 + li.SMOOTH)
        log = like + np.log(of_host)
        if said:
            every = sum(f[5] for f in facts if f[3])
            log = log + np.log((sum(d) - own + 0.5) / (every + 0.5 * (len({f[3] for f in facts if f[3]}) + 1)))
        p = np.exp(log - log.max())
        want[i] = (lang[int(log.argmax())], 1 / p.sum())
    for bound in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", bound)
        got = {r.page_id: r for r in li.identify(pages, None, model).collect()}
        assert len(got) == len(want) and all(got[i].language == w[0] and math.isclose(got[i].confidence, w[1], abs_tol=2e-5) for i, w in want.items())


def test_many_rows_without_id_and_long_references(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = li.train(docs)
    rows = [(None, None, "<p>&#" + "9" * 5000 + ";</p>")] * 50
    assert li.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), None, model).count() == 50
