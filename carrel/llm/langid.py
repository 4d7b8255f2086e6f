"""Language identification by Bayesian evidence fusion.

For each text the posterior over languages is proportional to

    P(text | language) * P(declared markup language | language) * P(language | host)

* Text: a multinomial model over hashed byte trigrams, with counts over all training documents; a text's mean log-likelihood counts as
  that of at most ``WEIGHT`` trigrams, as neighbouring trigrams are no independent evidence.
* Declared markup language: how often each language is declared as what, counted with the posteriors of the text
  and smoothed; so a declaration weighs as much as it is right in this corpus.
* Address suffix and host: grouped sums of the texts' posteriors; the host's prior is smoothed towards its suffix's, that towards the
  corpus's. A text's own share is taken out of its host's and suffix's sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.llm.common import crc_fold, spread_join, stored
from carrel.llm.html import decoded

BITS, WEIGHT, SMOOTH = 15, 40.0, 8.0
#: The table of all languages' trigrams has up to this many cells: the more languages, the fewer buckets each, down to 2^10.
CELLS = 1 << 23
_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[65:91] += 32
_LETTER[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32
_TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)", re.S | re.I)


def trigrams(text: str | None, bits: int = BITS) -> np.ndarray:
    """A bucket, of 2^bits, for each three bytes of the text in which ASCII capitals are lower-cased and runs of other ASCII marks are one blank."""
    c = _LETTER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(c):
        return np.empty(0, np.int64)
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    key = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def page_text(page: str | None) -> str:
    """What a page shows, roughly: without scripts, styles, comments and tags."""
    return decoded(_TAGS.sub(" ", page or ""))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log: np.ndarray  # language x bucket
    prior: np.ndarray
    bits: int = BITS

    def likelihood(self, text: str | None) -> np.ndarray:
        """Log-likelihood of the text by language, as of at most ``WEIGHT`` trigrams; 0 for no text."""
        t = trigrams(text, self.bits)
        if not len(t):
            return np.zeros(len(self.languages))
        buckets = 1 << self.bits
        counts = np.bincount(t, minlength=buckets) if len(t) > buckets // 4 else None
        total = self.log @ counts if counts is not None else self.log[:, t].sum(1)
        return total * (WEIGHT / (WEIGHT + len(t)))


def _count(bits: int):
    buckets = 1 << bits

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in held and (len(held) + 1) * buckets > CELLS:
                    yield from rows(held)
                    held.clear()
                own = held.setdefault(lang, np.zeros(buckets, np.int64))
                t = trigrams(text.as_py(), bits)
                if len(t) > buckets // 4:
                    own += np.bincount(t, minlength=buckets)
                else:
                    np.add.at(own, t, 1)
        yield from rows(held)

    return run


def train(docs: DataFrame) -> Model:
    """Counts trigrams by ``lang`` over all documents outside the held-out fold whose lang is known.

    Any number of languages is learned. The names of the languages and their table, of about ``CELLS`` numbers, are held by the driver and by every task.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold() != 1)).select(F.lower("lang").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = sorted(r[0] for r in known.select("lang").distinct().collect())
    bits = max(10, min(BITS, (CELLS // max(1, len(languages))).bit_length() - 1))
    counts = np.zeros((max(1, len(languages)), 1 << bits))
    got = known.mapInArrow(_count(bits), "lang string, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    if got.num_rows:
        where = {x: i for i, x in enumerate(languages)}
        np.add.at(counts, (np.array([where[x] for x in got.column("lang").to_pylist()]), got.column("bucket").to_numpy()), got.column("c").to_numpy())
    log = np.log(counts + 0.5) - np.log((counts + 0.5).sum(1, keepdims=True))
    share = (counts.sum(1) + 1) / (counts.sum(1) + 1).sum()
    return Model(languages or ["und"], log, share, bits)


def _normalised(likelihood: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = likelihood + np.log(prior)
    z = np.exp(z - z.max())
    return z / z.sum()


def _texts(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            likelihoods, posteriors = [], []
            for markup, text in zip(batch.column("is_page").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                x = m.likelihood(page_text(text) if markup else text)
                likelihoods.append(x.tolist())
                posteriors.append(_normalised(x, m.prior).tolist())
            keep = [batch.column(c) for c in ("doc_id", "page_id", "host", "suffix", "declared")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(likelihoods, pa.list_(pa.float64())), pa.array(posteriors, pa.list_(pa.float64()))], names=["doc_id", "page_id", "host", "suffix", "declared", "likelihood", "posterior"])

    return run


def declared_language(page: Column) -> Column:
    """The primary subtag of the lang attribute of the html tag, lower case; null where there is none."""
    head = F.regexp_extract(page, r"(?is)<html\b([^>]*)", 1)
    tag = F.lower(F.regexp_extract(head, r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _masses(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, mass (language number to the sum of the texts' posteriors) and n, the sum of all. What is below 1e-9 of a text counts as 0."""
    sums = texts.select(*keys, F.posexplode("posterior").alias("i", "p")).where("p > 1e-9").groupBy(*keys, "i").agg(F.sum("p").alias("p"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("mass"), F.sum("p").alias("n"))


def _total(masses: DataFrame, n: int) -> list[float]:
    got = dict(masses.select(F.explode("mass").alias("i", "p")).groupBy("i").agg(F.sum("p")).collect())
    return [got.get(i) or 0.0 for i in range(n)]


def identify(pages: DataFrame | None, docs: DataFrame | None, model: Model, smooth: float = SMOOTH) -> DataFrame:
    """doc_id or page_id, host, declared, language, confidence and text_language of every page and document.

    Pages give markup language, address suffix (the host's last label) and host; documents give their ``source`` as host. A null or
    empty text says nothing, so what is left decides; a null url has no host and gets the prior of all texts without one. Rows are
    judged one by one, so repeated ids do no harm. Ties go to the first language in alphabetical order. Empty tables give no rows.
    """
    spark = (pages if pages is not None else docs).sparkSession
    n, null = len(model.languages), lambda kind: F.lit(None).cast(kind)
    rows = []
    if pages is not None:
        host = host_of(F.col("url"))
        rows.append(pages.select(null("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.substring_index(host, ".", -1).alias("suffix"), declared_language(F.col("html")).alias("declared"), F.lit(True).alias("is_page"), F.col("html").alias("text")))
    if docs is not None:
        rows.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), null("long").alias("page_id"), F.col("source").alias("host"), null("string").alias("suffix"), null("string").alias("declared"), F.lit(False).alias("is_page"), F.col("text")))
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    texts = both.mapInArrow(_texts(spark.sparkContext.broadcast(model)), "doc_id long, page_id long, host string, suffix string, declared string, likelihood array<double>, posterior array<double>")
    texts = stored(texts.select("*", F.coalesce("host", F.lit("")).alias("h"), F.coalesce("suffix", F.lit("")).alias("s")), "texts")
    hosts = stored(_masses(texts, ["h", "s"]), "hosts")
    suffixes = hosts.select("s", F.explode("mass").alias("i", "p")).groupBy("s", "i").agg(F.sum("p").alias("p")).groupBy("s")
    suffixes = stored(suffixes.agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("suffix_mass"), F.sum("p").alias("suffix_n")), "suffixes")
    base = np.array(_total(hosts, n)) + 1
    base = F.lit((base / base.sum()).tolist())
    said = stored(_masses(texts.where("declared IS NOT NULL"), ["declared"]), "declared")
    kinds, totals = said.count() + 1, F.lit(_total(said, n))
    wide = F.lit(32 * n)
    of = suffixes.join(hosts.groupBy("s").agg(F.count("*").alias("rows")), "s")
    priors = spread_join(hosts, of, ["s"], wide=wide).withColumn("rows", F.col("n").cast("long"))
    d = spread_join(texts, priors, ["h", "s"], wide=wide)
    d = spread_join(d, said.select("declared", F.col("mass").alias("said"), F.col("n").cast("long").alias("rows")), ["declared"], "left", wide=wide)

    def fused(i):
        of = lambda mass: F.greatest(F.coalesce(F.try_element_at(mass, i), F.lit(0.0)) - F.get("posterior", i), F.lit(0.0))
        less = lambda count: F.greatest(F.col(count) - 1, F.lit(0.0)) + smooth
        suffix = (of(F.col("suffix_mass")) + smooth * F.get(base, i)) / less("suffix_n")
        host = (of(F.col("mass")) + smooth * F.greatest(suffix, F.lit(1e-9))) / less("n")
        declared = F.when(F.col("said").isNull(), F.lit(1.0)).otherwise((of(F.col("said")) + 0.5) / (F.get(totals, i) + 0.5 * kinds))
        return F.get("likelihood", i) + F.log(F.greatest(host, F.lit(1e-12))) + F.log(declared)

    d = d.select("doc_id", "page_id", "host", "declared", "posterior", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), fused).alias("log"))
    top = F.array_max("log")
    names = F.lit(model.languages).cast("array<string>")
    named = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    mass = F.aggregate(F.transform("log", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return d.select("doc_id", "page_id", "host", "declared", named(F.col("log")).alias("language"), F.round(1 / mass, 6).alias("confidence"), named(F.col("posterior")).alias("text_language"))
