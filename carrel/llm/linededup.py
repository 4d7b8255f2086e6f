"""Line dedup by a log-template tree, in DataFrame functions only.

A line is what stands between two line feeds, trimmed of blanks; its words are parted by single blanks. A template is a line some of whose words are
variable fields. It fixes at least ``need(n) = max(70 % of n, 5)`` of its n words, whatever its length, so a line of up to five words is its own template.

* Words that hold a digit are variable fields, ``<*>``, if the other words are at least ``need(n)``; else the line stays as it is, so that unlike rows of
  numbers stay unlike.
* The tree has a fixed depth: the number of words, the first ``LEAD`` words, then one of the ``BANDS`` equal parts of the rest. So a leaf (words, lead) holds
  as many groups as it holds different parts, and a line is in one group for each of its parts. One more path leaves the leading words open and
  fixes all words behind them.
* A group's first line (the least) founds its template, and the lines that agree with it on at least ``need(n)`` fixed words belong to it.

A template recurs if it stands in at least two unlike documents, and its lines are dropped from every document that has them, whatever they leave of it.
Copies of one document are not unlike: equal texts count once, and so do revised copies. A revised copy is a text of ``LEAST`` words or more, at least a
tenth of whose words are in lines that stand in two texts or more. It is held against the text with the least doc_id that shares one of
four min-hashes with it (the least and the greatest md5, read forward or backward, of its 5-word shingles whose first word's length is a multiple of ``SAMPLE``), which stands for it if the Jaccard similarity of their shingles is 0.8 or more, or if it is 0.5 or more and what they have
beside such lines is alike, too: nothing in one of them, or at least half of the fewer words of the two. (Short pages that share a long footer alone
are no copies.) Nothing is removed on that ground: it only says that two copies are no evidence that a line recurs. So copies keep what they share with
one another alone, and which of them stays is left to near-duplicate removal.

Lines and texts are told apart by two 64-bit hashes with different seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrel.llm import common
from carrel.llm.common import WORD, scope, spread_join, stored

LEAD, BANDS, ALIKE, FIXED = 3, 4, 7, 5
SHINGLE, LEAST, SAMPLE = 5, 20, 4
#: Per cent of shingles in common that make a revised copy, and that do where the rest is alike.
NEAR, HALF = 80, 50
#: Texts that are compared with one text in one task.
PER_TASK = 256


def need(n: Column) -> Column:
    """How many of ``n`` words a template fixes at least."""
    return F.greatest(F.ceil(ALIKE * n / F.lit(10)), F.lit(FIXED))


def _two(*columns) -> list[Column]:
    return [F.xxhash64(*columns), F.xxhash64(F.lit("2"), *columns)]


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """A row per line that is not blank: pos, n (its words) and line, with its variable fields, after the columns ``more``."""
    d = docs.select(*more, F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    d = d.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    masked = F.when((F.col("n") > FIXED) & F.col("line").rlike("[0-9]"), F.regexp_replace("line", "(^| )[^ 0-9]*+[0-9][^ ]*+", "$1<*>"))
    d = d.withColumn("masked", masked)
    fields = (F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit("<*>"), F.lit("")))) / 3
    return d.withColumn("line", F.when(F.col("n") - fields >= need(F.col("n")), F.col("masked")).otherwise(F.col("line"))).drop("masked")


def _leaf_and_tail(line: Column, n: Column) -> list[Column]:
    """The leaf of a line, and its group with open leading words, as hashes of their paths; null where it has no room for a variable field."""
    lead = F.substring_index(line, " ", LEAD)
    # Bytes, which need not be counted as characters; a line of so many words has a rest.
    rest = F.substr(line.cast("binary"), F.octet_length(lead) + 2)
    return [F.when(n > FIXED, c).alias(k) for k, c in (("leaf", F.xxhash64(F.lit("leaf"), n, lead)), ("tail", F.xxhash64(F.lit("tail"), n, rest)))]


def _bands(line: Column, n: Column, leaf: Column) -> Column:
    """The groups of a line in its leaf, as hashes of their paths."""
    words = F.split(line, " ", -1)
    cut = [(F.floor(k * (n - LEAD) / F.lit(BANDS)) + LEAD).cast("int") for k in range(BANDS + 1)]
    return F.array(*(F.xxhash64(F.lit(k), leaf, F.slice(words, cut[k] + 1, cut[k + 1] - cut[k])) for k in range(BANDS)))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, t1 and t2 (the text), pos, n, h1 and h2 (the line), leaf and tail, for each line; written to the shared folder."""
    t1, t2 = _two("text")
    rows = _lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), "text"), *(F.col(c) for c in ("doc_id", "t1", "t2")))
    h1, h2 = _two("line")
    return stored(rows.select("doc_id", "t1", "t2", "pos", "n", h1.alias("h1"), h2.alias("h2"), *_leaf_and_tail(F.col("line"), F.col("n"))), "lines")


def _in_company(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Of the distinct ``lines`` those that are not alone in their leaf (in_leaf) or with their tail (in_tail), with n and line beside their columns."""
    several = lines.select(F.explode(F.array("leaf", "tail")).alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    several = stored(several, "leaves")
    for k in ("leaf", "tail"):
        lines = spread_join(lines, several.select(F.col("key").alias(k), F.lit(True).alias(f"in_{k}"), "rows"), [k], "left")
    some = stored(lines.where("in_leaf OR in_tail").select("h1", "h2", "c", "lo", "hi", "leaf", "in_leaf", "in_tail", "tail"), "some-lines")
    # A line is read from the least of its texts; others need not be cut into lines where that is cheap to tell.
    owners = some.select(F.col("lo").alias("t1")).distinct()
    texts = docs.select(_two("text")[0].alias("t1"), "text")
    if owners.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        texts = texts.join(F.broadcast(owners), "t1", "left_semi")
    h1, h2 = _two("line")
    read = _lines(texts.select("text")).where(F.col("n") > FIXED).select(h1.alias("h1"), h2.alias("h2"), "n", "line")
    read = spread_join(read, some.select("h1", "h2", F.col("c").alias("rows")), ["h1", "h2"]).groupBy("h1", "h2").agg(F.min("line").alias("line"), F.first("n").alias("n"))
    return stored(some.join(read, ["h1", "h2"]), "in-company")


def _fits(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2 and key of each line that belongs to the template of the group ``key``, for groups in two texts or more.

    ``lines``: the distinct lines with leaf and tail, c (how often), lo and hi (the least and the greatest of their texts).
    """
    named = ["h1", "h2", "c", "lo", "hi"]
    some = _in_company(docs, lines.where("leaf IS NOT NULL"))
    by_leaf = some.where("in_leaf").select(F.explode(_bands(F.col("line"), F.col("n"), F.col("leaf"))).alias("key"), *named)
    at = stored(by_leaf.unionByName(some.where("in_tail").select(F.col("tail").alias("key"), *named)), "paths")
    groups = at.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor("h1").alias("all"), F.count("*").alias("kinds")).where("a < b AND lo < hi")
    # Groups of the same lines have the same template: one of them will do.
    groups = stored(groups.groupBy("a", "b", "all", "kinds").agg(F.min("key").alias("key")).select("key", F.col("kinds").alias("rows")), "groups")
    members = spread_join(at, groups, ["key"]).select("key", *named)
    kinds = stored(members.join(some.select("h1", "h2", "line"), ["h1", "h2"]), "kinds")
    first = stored(kinds.groupBy("key").agg(F.min("line").alias("first"), F.count("*").alias("rows")), "first")
    a, b = F.split("line", " ", -1), F.split("first", " ", -1)
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != "<*>"), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    fits = spread_join(kinds, first, ["key"], wide=F.octet_length("first")).where((F.size(a) == F.size(b)) & (agree >= need(F.size(a)))).select("key", *named)
    return stored(fits, "fits", keep=True)


def _words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased, by the white space of ``WORD``; without a pattern, which would take most of the time."""
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.array_remove(F.split(plain, " ", -1), "")


def _starts(words: Column) -> Column:
    """Where the shingles of a text start."""
    return F.sequence(F.lit(1), F.greatest(F.size(words) - SHINGLE + 1, F.lit(1)))


def _families(docs: DataFrame, table: DataFrame, shared: DataFrame) -> DataFrame:
    """t1, t2 and family (t1 of the text that stands for it) of each revised copy. ``shared``: the lines of ``table`` that stand in two texts or more."""
    held = shared.groupBy("t1", "t2").agg(F.sum("n").alias("words"), F.collect_set("pos").alias("at"))
    whole = table.groupBy("t1", "t2").agg(F.sum("n").alias("total"), F.min("doc_id").alias("id"))
    suspects = stored(whole.join(held, ["t1", "t2"]).where("10 * words >= total AND id IS NOT NULL").select("t1", "t2", "id", "at"), "suspects")
    t1, t2 = _two("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), t1.alias("t1"), t2.alias("t2"), F.col("text").cast("string").alias("text"))
    texts = spread_join(texts, suspects.withColumn("rows", F.lit(1)), ["t1", "t2", "id"])
    # A column for each step: what stands in a lambda is worked out for each element.
    marks = texts.select("t1", "t2", "id", _words(F.col("text")).alias("words"))
    marks = marks.withColumn("at", F.filter(_starts(F.col("words")), lambda i: F.length(F.get("words", i - 1)) % SAMPLE == 0))
    marks = marks.withColumn("md5", F.transform("at", lambda i: F.md5(F.array_join(F.slice("words", i, SHINGLE), " ").cast("binary")))).withColumn("back", F.transform("md5", F.reverse))
    marks = marks.select("t1", "t2", "id", F.size("words").alias("n"), F.array(F.array_min("md5"), F.array_max("md5"), F.array_min("back"), F.array_max("back")).alias("m"))
    marks = stored(marks, "marks").where(F.col("n") >= LEAST)
    at = marks.select("t1", "t2", "id", F.posexplode("m").alias("k", "m")).where("m IS NOT NULL")
    rep = stored(at.groupBy("k", "m").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "rep")
    pairs = stored(spread_join(at, rep, ["k", "m"]).where("rep < id").select("t1", "t2", "rep").distinct(), "without-turns")
    # A text that stands for many is sent to as many tasks as they take.
    turns = stored(pairs.groupBy("rep").agg(F.count("*").alias("rows")).withColumn("turns", F.ceil(F.col("rows") / PER_TASK)), "turns")
    pairs = stored(spread_join(pairs, turns, ["rep"]).select("t1", "t2", "rep", F.pmod(F.xxhash64("t1"), F.col("turns")).alias("turn")), "pairs")
    # Whole texts of pairs alone are compared, each made into its set once.
    paired = pairs.select("t1", "t2").unionByName(spread_join(marks, turns.drop("turns").withColumnRenamed("rep", "id"), ["id"]).select("t1", "t2")).distinct()
    paired = stored(paired, "of-pairs")
    texts = spread_join(texts, paired.withColumn("rows", F.lit(1)), ["t1", "t2"]).groupBy("t1", "t2", "id").agg(F.min("text").alias("text"), F.first("at").alias("at"))
    own = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("at"), i)), "\n")
    texts = texts.select("t1", "t2", "id", _words(F.col("text")).alias("words"), F.array_distinct(_words(own)).alias("own"))
    sets = F.array_distinct(F.transform(_starts(F.col("words")), lambda i: F.xxhash64(F.slice("words", i, SHINGLE))))
    texts = stored(texts.select("t1", "t2", "id", sets.alias("s"), "own"), "paired")
    # Both sides grow with the input, so the join is one by shuffle at any size.
    of = pairs.select("rep", "turn").distinct().join(texts.select(F.col("id").alias("rep"), F.col("s").alias("s_rep"), F.col("own").alias("own_rep")), "rep")
    both = pairs.join(texts.select("t1", "t2", "s", "own").hint("merge"), ["t1", "t2"]).join(of.hint("merge"), ["rep", "turn"])
    both = both.select("t1", "t2", "rep", F.size(F.array_intersect("s", "s_rep")).alias("same"), (F.size("s") + F.size("s_rep")).alias("total"), F.size(F.array_intersect("own", "own_rep")).alias("rest"), F.least(F.size("own"), F.size("own_rep")).alias("least"))
    near = both.where(f"100 * same >= {NEAR} * (total - same) OR 100 * same >= {HALF} * (total - same) AND 2 * rest >= least").groupBy("t1", "t2").agg(F.min("rep").alias("rep"))
    near = near.join(texts.select(F.col("id").alias("rep"), F.col("t1").alias("family")).groupBy("rep").agg(F.min("family").alias("family")), "rep")
    near = stored(near, "near")
    # The text that stands for it may itself be a revised copy.
    up = near.select(F.col("t1").alias("family"), F.col("family").alias("up"))
    load = near.groupBy("family").agg(F.count("*").alias("rows"))
    again = spread_join(near, stored(up.join(load, "family"), "up"), ["family"]).select("t1", "t2", F.col("up").alias("u"))
    return stored(near.join(again, ["t1", "t2"], "left").select("t1", "t2", F.coalesce("u", "family").alias("family")), "families", keep=True)


def recurring(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, t1, t2 and pos of all lines of recurring templates. ``table``: ``line_table(docs)``."""
    lines = table.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("t1").alias("lo"), F.max("t1").alias("hi"), F.min("leaf").alias("leaf"), F.min("tail").alias("tail"))
    lines = stored(lines, "distinct-lines")
    with scope(docs.sparkSession):
        fits = _fits(docs, lines)
    wide = fits.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("rows")).where("lo < hi").select("key", "rows")
    wide = stored(wide, "wide")
    grouped = spread_join(fits.select("key", "h1", "h2", "c"), wide, ["key"]).select("h1", "h2", "key", "c")
    exact = lines.where("lo < hi").select("h1", "h2", F.lit(None).cast("long").alias("key"), "c")
    candidates = stored(exact.unionByName(grouped), "candidates")
    some = stored(candidates.groupBy("h1", "h2").agg(F.max("c").alias("rows")), "some")
    shared = stored(spread_join(table.select("doc_id", "t1", "t2", "pos", "n", "h1", "h2"), some, ["h1", "h2"]).drop("rows"), "shared-lines")
    with scope(docs.sparkSession):
        families = _families(docs, table, shared)
    load = stored(shared.groupBy("t1", "t2").agg(F.count("*").alias("rows")).join(families, ["t1", "t2"]), "load")
    copies = spread_join(shared, load, ["t1", "t2"], "left").select("h1", "h2", F.coalesce("family", "t1").alias("family"))
    per_line = stored(copies.groupBy("h1", "h2").agg(F.min("family").alias("lo"), F.max("family").alias("hi")), "families-of-lines")
    held = candidates.join(per_line, ["h1", "h2"])
    found = held.where("key IS NULL AND lo < hi").select("h1", "h2", "c")
    kept = held.where("key IS NOT NULL").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("rows")).where("lo < hi").select("key", "rows")
    kept = stored(kept, "kept")
    more = spread_join(grouped, kept, ["key"]).select("h1", "h2", "c")
    drop = stored(found.unionByName(more).groupBy("h1", "h2").agg(F.max("c").alias("rows")), "recurring")
    return spread_join(shared, drop, ["h1", "h2"]).select("doc_id", "t1", "t2", "pos")


def without_recurring(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; ``text`` without the lines of recurring templates; added: n_lines, n_dropped.

    A blank line stays. A text all of whose lines recur is empty then. A null or empty text stays as it is, with 0 dropped. Documents are
    told apart by their texts, so rows that share a doc_id, or have none, need no rule; each is cleaned. A text whose rows all have a null
    doc_id counts as a document of its own, also where it is a revised copy. Clashing columns n_lines and n_dropped of the input are replaced.
    An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    with scope(docs.sparkSession):
        drop = recurring(docs, line_table(docs)).groupBy("doc_id", "t1", "t2").agg(F.collect_set("pos").alias("_drop"))
        drop = stored(drop, "dropped-lines", keep=True)
    drop = drop.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "_drop")
    text = F.col("text").cast("string")
    t1, t2 = _two(docs["text"])
    # By hash, as whole texts need not be sorted; ``drop`` has a row for a text.
    d = docs.join(drop.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    n_lines = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    out = [F.when(F.col("_drop").isNull(), text).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return d.select(*out, n_lines.cast("int").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).alias("n_dropped"))


def _oracle() -> str:
    need = f"greatest(({ALIKE} * n + 9) // 10, {FIXED})"
    tail = f"'t:' || n || ':' || array_to_string(words[{LEAD + 1}:], ' ')"
    at = [f"({LEAD} + ({k} * (n - {LEAD})) // {BANDS})" for k in range(BANDS + 1)]
    bands = ", ".join(f"'b{k}:' || n || ':' || array_to_string(words[1:{LEAD}], ' ') || ':' || array_to_string(words[{at[k]} + 1:{at[k + 1]}], ' ')" for k in range(BANDS))
    some = f"list_transform(list_filter(range(1, len(words) - {SHINGLE - 2}), lambda i: length(words[i]) % {SAMPLE} = 0), lambda i: md5(array_to_string(words[i:i + {SHINGLE - 1}], ' ')))"
    md5, back = "sampled", "list_transform(sampled, lambda x: reverse(x))"
    mins = f"list_min({md5}), list_max({md5}), list_min({back}), list_max({back})"
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + WORD + "')"
    return rf"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS raws FROM documents),
l AS (SELECT doc_id, text, unnest(raws) AS raw, generate_subscripts(raws, 1) AS pos FROM raw),
s0 AS (SELECT doc_id, text, pos, trim(raw, ' ') AS line, len(string_split(trim(raw, ' '), ' ')) AS n FROM l WHERE trim(raw, ' ') <> ''),
s1 AS (SELECT *, regexp_replace(line, '(^| )[^ 0-9]*[0-9][^ ]*', '\1<*>', 'g') AS masked FROM s0),
s AS (SELECT doc_id, text, pos, n, line AS own, CASE WHEN line <> masked AND n - (length(masked) - length(replace(masked, '<*>', ''))) / 3 >= {need} THEN masked ELSE line END AS line FROM s1),
u AS (SELECT DISTINCT line, n, string_split(line, ' ') AS words FROM s),
k AS (SELECT line, n, words, unnest([{tail}, {bands}]) AS key FROM u WHERE n > {FIXED}),
f AS (SELECT key, min(line) AS first FROM k GROUP BY key HAVING count(*) > 1),
c AS (SELECT line, key, n, words, string_split(first, ' ') AS model FROM k JOIN f USING (key)),
a AS (SELECT line, key FROM c WHERE len(list_filter(list_zip(words, model), lambda x: x[1] = x[2] AND x[1] <> '<*>')) >= {need}),
m AS (SELECT line, 'x' || line AS key FROM u UNION ALL SELECT line, key FROM a),
t AS (SELECT DISTINCT m.key, m.line, s.text FROM m JOIN s USING (line)),
g AS (SELECT key FROM t GROUP BY key HAVING count(DISTINCT text) > 1),
sl AS (SELECT DISTINCT line FROM t JOIN g USING (key)),
w AS (SELECT s.text, min(doc_id) AS id, list(own) FILTER (sl.line IS NULL) AS own FROM s LEFT JOIN sl USING (line) GROUP BY s.text HAVING 10 * coalesce(sum(n) FILTER (sl.line IS NOT NULL), 0) >= sum(n)),
w1 AS (SELECT id, text, {words.format('text')} AS words, list_distinct({words.format("array_to_string(coalesce(own, []), ' ')")}) AS own FROM w),
w2b AS (SELECT id, text, own, {some} AS sampled, list_distinct(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' '))) AS s FROM w1 WHERE len(words) >= {LEAST}),
w3 AS (SELECT id, unnest([{mins}]) AS h, generate_subscripts([{mins}], 1) AS j FROM w2b),
w4 AS (SELECT DISTINCT id, min(id) OVER (PARTITION BY j, h) AS rep FROM w3 WHERE h IS NOT NULL),
w5 AS (SELECT x.id, x.rep, len(list_intersect(p.s, q.s)) AS same, len(p.s) + len(q.s) AS total, len(list_intersect(p.own, q.own)) AS rest, least(len(p.own), len(q.own)) AS fewer FROM w4 x JOIN w2b p ON p.id = x.id JOIN w2b q ON q.id = x.rep WHERE x.rep < x.id),
w6 AS (SELECT id, min(rep) AS rep FROM w5 WHERE 100 * same >= {NEAR} * (total - same) OR (100 * same >= {HALF} * (total - same) AND 2 * rest >= fewer) GROUP BY id),
w7 AS (SELECT x.id, coalesce(y.rep, x.rep) AS rep FROM w6 x LEFT JOIN w6 y ON y.id = x.rep),
e AS (SELECT w.text, 'f' || rep AS family FROM w7 JOIN w ON w.id = w7.id UNION ALL SELECT text, 'f' || id FROM w WHERE id NOT IN (SELECT id FROM w7)),
r AS (SELECT key FROM t LEFT JOIN e USING (text) GROUP BY key HAVING count(DISTINCT coalesce(family, 't' || t.text)) > 1),
h AS (SELECT DISTINCT doc_id, text, pos FROM s JOIN m USING (line) WHERE m.key IN (FROM r)),
o AS (SELECT l.doc_id, l.text, string_agg(raw, chr(10) ORDER BY pos) FILTER (h.pos IS NULL) AS rest, count(*) FILTER (h.pos IS NOT NULL) AS hits FROM l LEFT JOIN h USING (doc_id, text, pos) GROUP BY ALL)
SELECT doc_id, CASE WHEN hits > 0 THEN coalesce(rest, '') ELSE text END AS text, coalesce(len(raws), 0)::INT AS n_lines, coalesce(hits, 0)::INT AS n_dropped FROM raw LEFT JOIN o USING (doc_id, text)
"""


#: The same rows in SQL.
ORACLE = _oracle()
