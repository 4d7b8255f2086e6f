"""Record linkage between two lists of people made of customers: all of them, and all of them again with slips."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from carrel.functions.hashing import hmac_sql
from carrel.functions.metaphone import metaphone
from carrel.operators import linkage as ln
from carrel.registry import Tables, query

c = F.col
FORENAMES = "ALICE ROBERT MARY JOHN SUSAN DAVID EMMA PETER LAURA JAMES".split()
SURNAMES = "SMITH SMYTHE SCHMIDT JONES TAYLOR TAILOR BROWN BRAUN WILSON WALKER EVANS EVERETT".split()
CFG = ln.Config()
_CODES = {n: metaphone(n) for n in FORENAMES + SURNAMES}
_P = {n: (i + 1) / 1000 for i, n in enumerate(FORENAMES + SURNAMES)}


def _pick(names, at):
    return F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))


def _people(t: Tables, slips: bool):
    k = c("c_custkey")
    dob = F.date_add(F.lit("1940-01-01").cast("date"), ((k * 7919) % 21000).cast("int"))
    other = F.date_add(F.lit("1940-01-01").cast("date"), ((k * 7919 + 400) % 21000).cast("int"))
    fore, sur = _pick(FORENAMES, k * 7 % 10), _pick(SURNAMES, k * 5 % 12)
    gender = F.when(k % 2 == 0, "F").otherwise("M")
    code = F.concat(F.lit("CB"), (k % 9 + 1).cast("string"), (k % 10).cast("string"), F.lit("EB"))
    if slips:
        dob = F.when(k % 15 == 0, other).otherwise(dob)
        sur = F.when(k % 20 == 5, _pick(SURNAMES, (k * 5 + 1) % 12)).otherwise(sur)
        code = F.when(k % 25 == 0, None).otherwise(code)
    d = t.customer.select(F.concat(F.lit("p" if slips else "s"), k.cast("string")).alias("id"), fore.alias("forename"), sur.alias("surname"), dob.alias("dob"), gender.alias("gender"), code.alias("postcode"))
    table = F.create_map(*(F.lit(x) for n, m in _CODES.items() for x in (n, m)))
    d = d.withColumn("forename_code", table[c("forename")]).withColumn("surname_code", table[c("surname")])
    fragment = [c("surname").alias("name"), c("surname_code").alias("code"), F.substring("surname", 1, 2).alias("two")]
    if not slips:
        return d.withColumn("surname_fragments", F.array(F.struct(*fragment)))
    freq = {n: (p, max(CFG.least_frequency, sum(_P[m] for m in _P if _CODES[m] == _CODES[n]) - p), max(CFG.least_frequency, sum(_P[m] for m in _P if m[:2] == n[:2] and _CODES[m] != _CODES[n]))) for n, p in _P.items()}
    for j, x in enumerate(("name", "code", "two")):
        values = F.create_map(*(F.lit(v) for n, f in freq.items() for v in (n, f[j])))
        d = d.withColumn(f"f_{x}", values[c("forename")]).withColumn(f"s_{x}", values[c("surname")])
    d = d.withColumn("surname_fragments", F.array(F.struct(*fragment, *(c(f"s_{x}").alias(f"p_{x}") for x in ("name", "code", "two")))))
    return d.withColumn("p_unit", F.lit(1e-6)).withColumn("p_sector", F.lit(1e-4))


_SQL_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _people_sql(slips: bool) -> str:
    fore, sur = f"{_SQL_LIST(FORENAMES)}[1 + c_custkey * 7 % 10]", f"{_SQL_LIST(SURNAMES)}[1 + c_custkey * 5 % 12]"
    dob, code = "DATE '1940-01-01' + (c_custkey * 7919 % 21000)::INT", "'CB' || (c_custkey % 9 + 1) || (c_custkey % 10) || 'EB'"
    if slips:
        dob = f"CASE WHEN c_custkey % 15 = 0 THEN DATE '1940-01-01' + ((c_custkey * 7919 + 400) % 21000)::INT ELSE {dob} END"
        sur = f"CASE WHEN c_custkey % 20 = 5 THEN {_SQL_LIST(SURNAMES)}[1 + (c_custkey * 5 + 1) % 12] ELSE {sur} END"
        code = f"CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE {code} END"
    return f"SELECT '{'p' if slips else 's'}' || c_custkey AS id, {fore} AS forename, {sur} AS surname, ({dob})::DATE AS dob, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, {code} AS postcode FROM customer"


_PAIRS = f"WITH p AS ({_people_sql(True)}), s AS ({_people_sql(False)}), pairs AS (SELECT p.id AS proband_id, s.id AS candidate_id, CASE WHEN p.dob = s.dob THEN 1 WHEN strftime(p.dob, '%m-%d') = strftime(s.dob, '%m-%d') THEN 2 WHEN strftime(p.dob, '%Y-%d') = strftime(s.dob, '%Y-%d') THEN 3 ELSE 4 END AS priority, p.dob AS pd, s.dob AS sd, p.gender AS pg, s.gender AS sg, p.postcode AS pp, s.postcode AS sp, p.forename AS pf, s.forename AS sf, p.surname AS ps, s.surname AS ss FROM p JOIN s ON (day(p.dob) = day(s.dob) AND month(p.dob) = month(s.dob)) OR (day(p.dob) = day(s.dob) AND year(p.dob) = year(s.dob)) OR (month(p.dob) = month(s.dob) AND year(p.dob) = year(s.dob)))"


@query("lnk_02_shortlist", _PAIRS + " SELECT proband_id, candidate_id, priority::INT AS priority FROM pairs")
def _(t: Tables):
    return ln.shortlist(_people(t, True), _people(t, False))


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


_DOB = f"CASE WHEN pd = sd THEN {_num(math.log(1 - CFG.dob_ep) - math.log(CFG.dob_f))} ELSE {_num(math.log(CFG.dob_ep) - math.log(CFG.dob_p))} END"
_KNOWN = 1 - CFG.other_gender
_GF = f"(CASE WHEN pg = 'F' THEN {_num(CFG.female_of_known * _KNOWN)} ELSE {_num((1 - CFG.female_of_known) * _KNOWN)} END)"
_GENDER = f"CASE WHEN pg = sg THEN ln({_num(1 - CFG.gender_e)}) - ln({_GF}) ELSE ln({_num(CFG.gender_e)}) - ln(1 - {_GF}) END"
_KP = 1 - CFG.k_pseudo * CFG.unknown_postcode
_UNIT, _SECTOR = 1e-6 * CFG.k_postcode * _KP, 1e-4 * CFG.k_postcode * _KP
_POST = f"CASE WHEN pp IS NULL OR sp IS NULL THEN 0 WHEN pp = sp THEN {_num(math.log(1 - CFG.postcode_ep - CFG.postcode_en) - math.log(_UNIT))} WHEN left(pp, -2) = left(sp, -2) THEN {_num(math.log(CFG.postcode_ep) - math.log(_SECTOR - _UNIT))} ELSE {_num(math.log(CFG.postcode_en) - math.log(1 - _SECTOR))} END"


def _name_sql(p: str, s: str, errors) -> str:
    rows = []
    for n, pn in _P.items():
        code = max(CFG.least_frequency, sum(_P[m] for m in _P if _CODES[m] == _CODES[n]) - pn)
        two = max(CFG.least_frequency, sum(_P[m] for m in _P if m[:2] == n[:2] and _CODES[m] != _CODES[n]))
        rows.append((n, pn, code, two))
    lookup = lambda i: "CASE " + p + " " + " ".join(f"WHEN '{r[0]}' THEN {_num(r[i])}" for r in rows) + " END"
    codes = lambda col: "CASE " + col + " " + " ".join(f"WHEN '{n}' THEN '{m}'" for n, m in _CODES.items()) + " END"
    e = [f"(CASE WHEN pg = 'F' THEN {_num(x[0])} ELSE {_num(x[1])} END)" for x in errors]
    return f"CASE WHEN {p} = {s} THEN ln(1 - {e[0]} - {e[1]} - {e[2]}) - ln({lookup(1)}) WHEN {codes(p)} = {codes(s)} THEN ln({e[0]}) - ln({lookup(2)}) WHEN left({p}, 2) = left({s}, 2) THEN ln({e[1]}) - ln({lookup(3)}) ELSE ln({e[2]}) - ln(1 - {lookup(1)} - {lookup(2)} - {lookup(3)}) END"


_FORE = _name_sql("pf", "sf", (CFG.forename_ep1, CFG.forename_ep2, CFG.forename_en))
_SUR = _name_sql("ps", "ss", (CFG.surname_ep1, CFG.surname_ep2, CFG.surname_en))
_SCORED = f"{_PAIRS}, scored AS (SELECT proband_id, candidate_id, priority, {_num(CFG.prior())} + ({_DOB}) + ({_GENDER}) + ({_POST}) + ({_FORE}) + ({_SUR}) AS log_odds FROM pairs)"


@query("lnk_04_08_scores", _SCORED + " SELECT proband_id, candidate_id, round(log_odds, 6) AS log_odds FROM scored")
def _(t: Tables):
    p, s = _people(t, True), _people(t, False)
    return ln.score_all(p, s, CFG).select("proband_id", "candidate_id", F.round("log_odds", 6).alias("log_odds"))


@query("lnk_11_link", _SCORED + ", ranked AS (SELECT *, row_number() OVER w AS rn, lead(log_odds) OVER w AS second FROM scored WINDOW w AS (PARTITION BY proband_id ORDER BY log_odds DESC, priority, candidate_id)) SELECT p.id AS proband_id, coalesce(log_odds >= 5 AND log_odds >= coalesce(second, '-infinity'::DOUBLE), FALSE) AS matched, CASE WHEN log_odds >= 5 AND log_odds >= coalesce(second, '-infinity'::DOUBLE) THEN candidate_id END AS match_id, round(CASE WHEN log_odds IS NULL THEN 0 ELSE 1 / (1 + exp(-log_odds)) END, 6) AS p_match FROM p LEFT JOIN ranked ON p.id = proband_id AND rn = 1")
def _(t: Tables):
    return ln.compare(_people(t, True), _people(t, False), CFG).select("proband_id", "matched", "match_id", F.round("p_match", 6).alias("p_match"))


@query("snk_04_match_result", _SCORED + ", ranked AS (SELECT *, row_number() OVER w AS rn, lead(log_odds) OVER w AS second FROM scored WINDOW w AS (PARTITION BY proband_id ORDER BY log_odds DESC, priority, candidate_id)) SELECT p.id AS proband_local_id, coalesce(log_odds >= 5 AND log_odds >= coalesce(second, '-infinity'::DOUBLE), FALSE) AS matched, round(CASE WHEN second IS NULL THEN NULL ELSE second END, 6) AS second_best_log_odds FROM p LEFT JOIN ranked ON p.id = proband_id AND rn = 1 ORDER BY proband_local_id")
def _(t: Tables):
    d = ln.compare(_people(t, True), _people(t, False), CFG)
    second = F.when(c("second_best") > -ln.INFINITY, F.round("second_best", 6))
    return d.select(c("proband_id").alias("proband_local_id"), "matched", second.alias("second_best_log_odds")).orderBy("proband_local_id")


@query("lnk_01_perfect", "SELECT 'p' || a.c_custkey AS proband_id, 's' || min(b.c_custkey::VARCHAR) AS candidate_id FROM customer a JOIN customer b ON b.c_custkey % 500 = a.c_custkey % 500 GROUP BY a.c_custkey")
def _(t: Tables):
    k = c("c_custkey")
    p = t.customer.select(F.concat(F.lit("p"), k).alias("id"), F.concat(F.lit("NHS:a"), (k % 500).cast("string"), F.lit(";other:")).alias("perfect_id"))
    s = t.customer.select(F.concat(F.lit("s"), k).alias("id"), F.concat(F.lit("nhsnum:A"), (k % 500).cast("string")).alias("perfect_id"))
    return ln.perfect_matches(p, s, {"nhs": "nhsnum"})


@query("lnk_10_best_pairs")
def _(t: Tables):
    k = c("c_custkey").cast("double")
    m = F.array(F.array(k % 7 - 2, k % 5 - 1), F.array(k % 3, k % 11 - 6))
    return t.customer.select("c_custkey", ln.best_pairs_udf()(m).alias("unordered"), ln.best_pairs_udf(True, 0.1)(m).alias("ordered"))


_H = lambda x: hmac_sql(x, "link-key", "sha256")


@query("lnk_12_hashed", f"WITH s AS ({_people_sql(True)}) SELECT {_H('id')} AS id, {_H('dob::VARCHAR')} AS dob, {_H('gender')} AS gender, {_H('postcode')} AS postcode_unit, {_H('left(postcode, -2)')} AS postcode_sector, {_H('forename')} AS forename, {_H('left(surname, 2)')} AS surname_two FROM s")
def _(t: Tables):
    return ln.hashed(_people(t, True), "link-key").select("id", "dob", "gender", "postcode_unit", "postcode_sector", "forename", "surname_two")


@query("lnk_13_repeated_ids", "SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def _(t: Tables):
    from carrel.operators.relational import duplicates

    return duplicates(t.orders.select(c("o_custkey").alias("id")), ["id"])


@query("lnk_16_entropy", "SELECT round(-sum(q * log2(q)), 9) AS bits FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM part GROUP BY p_name)")
def _(t: Tables):
    return ln.entropy(t.part.groupBy("p_name").agg(F.count("*").alias("n")), "n").select(F.round("bits", 9).alias("bits"))


_FREQ = "(VALUES " + ", ".join(f"('{n}', 'X', {p!r}::DOUBLE, '{_CODES[n]}')" for n, p in _P.items()) + ") AS f(name, gender, p, metaphone)"


@query("agg_07_name_frequency", f"SELECT name, p AS p_name, round(greatest(5e-6, sum(p) OVER (PARTITION BY metaphone)), 9) AS p_metaphone, round(greatest(5e-6, sum(p) OVER (PARTITION BY metaphone) - p), 9) AS p_metaphone_not_name, round(greatest(5e-6, sum(p) OVER (PARTITION BY left(name, 2))), 9) AS p_f2c, round(greatest(5e-6, sum(p) OVER (PARTITION BY left(name, 2)) - sum(p) OVER (PARTITION BY left(name, 2), metaphone)), 9) AS p_f2c_not_name_metaphone FROM {_FREQ}")
def _(t: Tables):
    names = t.spark.createDataFrame([(n, "X", p, _CODES[n]) for n, p in _P.items()], "name string, gender string, p double, metaphone string")
    d = ln.name_frequencies(names)
    return d.select("name", "p_name", *(F.round(x, 9).alias(x) for x in ("p_metaphone", "p_metaphone_not_name", "p_f2c", "p_f2c_not_name_metaphone")))


@query("agg_08_unknown_names", f"SELECT n_name AS name, coalesce(p, 5e-6) AS p FROM nation LEFT JOIN {_FREQ} ON name = CASE WHEN n_nationkey % 2 = 0 THEN 'SMITH' ELSE n_name END")
def _(t: Tables):
    names = t.spark.createDataFrame([(n, "X", p, _CODES[n]) for n, p in _P.items()], "name string, gender string, p double, metaphone string")
    d = t.nation.select(c("n_name").alias("nation"), F.when(c("n_nationkey") % 2 == 0, "SMITH").otherwise(c("n_name")).alias("n"))
    return ln.with_frequencies(d, ln.name_frequencies(names), "n", None).select(c("nation").alias("name"), c("p_name").alias("p"))


@query("agg_09_weighted_mean", "SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS mean FROM part GROUP BY 1")
def _(t: Tables):
    return t.part.groupBy("p_brand").agg(F.round(F.sum(c("p_retailprice") * c("p_size")) / F.sum("p_size"), 6).alias("mean"))


_UNITS = "(SELECT DISTINCT 'CB' || (c_custkey % 9 + 1) || (c_custkey % 10) || chr(65 + (c_custkey % 23)::INT) || 'A' AS unit, (c_custkey % 9) * 100 + c_custkey % 10 AS oa FROM customer)"


@query("agg_10_postcode_units", f"SELECT unit, round(1.0 / count(*) OVER (PARTITION BY oa) / (SELECT count(DISTINCT oa) FROM {_UNITS}), 12)::DOUBLE AS p_unit FROM {_UNITS}")
def _(t: Tables):
    k = c("c_custkey")
    unit = F.concat(F.lit("cb"), (k % 9 + 1).cast("string"), F.lit(" "), (k % 10).cast("string"), F.char(65 + k % 23), F.lit("A"))
    units, _ = ln.postcode_frequencies(t.customer.select(unit.alias("unit"), ((k % 9) * 100 + k % 10).alias("oa")))
    return units.select("unit", F.round("p_unit", 12).alias("p_unit"))


@query("agg_10_postcode_sectors", f"SELECT left(unit, -2) AS sector, round(count(DISTINCT oa) / (SELECT count(DISTINCT oa) FROM {_UNITS}), 12) AS p_sector FROM {_UNITS} GROUP BY 1")
def _(t: Tables):
    k = c("c_custkey")
    unit = F.concat(F.lit("CB"), (k % 9 + 1).cast("string"), (k % 10).cast("string"), F.char(65 + k % 23), F.lit("A"))
    _, sectors = ln.postcode_frequencies(t.customer.select(unit.alias("unit"), ((k % 9) * 100 + k % 10).alias("oa")))
    return sectors.select("sector", F.round("p_sector", 12).alias("p_sector"))


@query("agg_14_fold", "SELECT l_orderkey, round(sum(ln(l_quantity) - ln(50)), 6) AS s, bool_or(l_discount = 0.1) AS impossible FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(F.ln("l_quantity") - math.log(50)), 6).alias("s"), F.bool_or(c("l_discount") == 0.1).alias("impossible"))


@query("agg_15_best_two", "SELECT o_custkey, round(max(o_totalprice), 2) AS best, round(nth, 2) AS second FROM (SELECT o_custkey, o_totalprice, max(CASE WHEN rn = 2 THEN o_totalprice END) OVER (PARTITION BY o_custkey) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)) GROUP BY o_custkey, nth")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    d = t.orders.select("o_custkey", F.round("o_totalprice", 2).alias("best"), F.round(F.lead("o_totalprice").over(w), 2).alias("second"), F.row_number().over(w).alias("rn"))
    return d.where("rn = 1").drop("rn")


@query("num_06_round_significant", "SELECT p_partkey, CASE WHEN p_size = 0 THEN 0 ELSE round(x * power(10, 3 - floor(log10(x)) - 1)) / power(10, 3 - floor(log10(x)) - 1) END AS r FROM (SELECT p_partkey, p_size, p_retailprice / (p_size + 1) AS x FROM part)")
def _(t: Tables):
    from carrel.functions.numbers import round_significant

    return t.part.select("p_partkey", round_significant(c("p_retailprice") / (c("p_size") + 1), 3).alias("r"))


def _frequency(name: str) -> tuple[str, str, float, float, float]:
    """Code, first two letters and frequencies of a surname or a fragment of one."""
    code, two, p = metaphone(name), name[:2], _P.get(name, CFG.least_frequency)
    others = {n: f for n, f in _P.items() if n in SURNAMES}
    p_code = max(CFG.least_frequency, sum(f for n, f in others.items() if _CODES[n] == code) - p)
    p_two = max(CFG.least_frequency, sum(f for n, f in others.items() if n[:2] == two and _CODES[n] != code))
    return code, two, p, p_code, p_two


def _double(i: int) -> list[str]:
    """Fragments of the i-th double name, the whole first."""
    a, b = SURNAMES[i], SURNAMES[(i + 5) % 12]
    return [a + b, *sorted({a, b})]


def _candidate(i: int) -> str:
    """One of the two parts, a name that sounds like one, or another."""
    return {0: SURNAMES[i], 1: SURNAMES[(i + 5) % 12], 2: SURNAMES[(i + 1) % 12], 3: SURNAMES[(i + 8) % 12]}[i % 4]


def _expected(i: int, female: bool) -> float:
    """The same score worked out name by name, for the twelve double names."""
    e1, e2, en = (x[0 if female else 1] for x in (CFG.surname_ep1, CFG.surname_ep2, CFG.surname_en))
    other = _candidate(i)
    code, two, *_ = _frequency(other)
    own = [(f, *_frequency(f)) for f in _double(i)]
    for at, value, error, p in ((0, other, 1 - e1 - e2 - en, 3), (1, code, e1, 4), (2, two, e2, 5)):
        hits = [f[p] for f in own if f[at] == value]
        if hits:
            return math.log(error) - math.log(min(hits))
    _, _, _, p, pc, pt = own[0]
    return math.log(en) - math.log(1 - p - pc - pt)


@query("lnk_08_surname_fragments", "SELECT c_custkey, round(score, 9) AS score FROM customer JOIN (VALUES " + ", ".join(f"({i}, {g}, {_num(_expected(i, g == 0))})" for i in range(12) for g in (0, 1)) + ") AS x(i, g, score) ON c_custkey % 12 = i AND c_custkey // 12 % 2 = g")
def _(t: Tables):
    i, female = c("c_custkey") % 12, F.floor(c("c_custkey") / 12) % 2 == 0
    struct = lambda f: F.struct(*(F.lit(v).alias(k) for k, v in zip(("name", "code", "two", "p_name", "p_code", "p_two"), (f, *_frequency(f)), strict=True)))
    own = F.element_at(F.array(*(F.array(*map(struct, _double(k))) for k in range(12))), (i + 1).cast("int"))
    theirs = [F.element_at(F.array(*(F.array(F.lit(x)) for x in xs)), (i + 1).cast("int")) for xs in zip(*((_candidate(k), *_frequency(_candidate(k))[:2]) for k in range(12)), strict=True)]
    score = ln.surname_score(own, *theirs, ln.surname_errors(F.when(female, "F").otherwise("M"), CFG))
    return t.customer.select("c_custkey", F.round(score, 9).alias("score"))
