"""Queries over citations, classifiers, gates and verdicts, mostly on inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracol.functions import lexicons as lx
from veracol.functions import text as t
from veracol.operators import citations, classify, verdict
from veracol.plans.common import Catalog, Rows, sql_list, table
from veracol.plans.text_queries import FEATURES, features

catalog = Catalog()

# --- citations -----------------------------------------------------------------------------------------------

SENTENCES = Rows("s", "id long, sentence string", [
    (1, "Known [1] and [2, 3], see [5-7]."), (2, "[4-6] [4–6] [4—6]"), (3, "[smith2020; Ivanov_21] and [a2020, b2021]"),
    (4, "[1 2] then [7-5] and []"), (5, "no brackets"), (6, "[1-999999] long, [ 8 ; 9 ]"), (7, "[Иванов 2019]"), (8, None),
])
DOCS = Rows("d", "doc_id long, text string", [
    (1, "Text cites [1] and [3].\nReferences\n1. First entry\n2. Second entry"),
    (2, "Cites [1, 2].\nСписок литературы\n[1] Иванов И. Книга\n  continued here\n[2] Petrov\n[1] Later entry"),
    (3, "Cites [1], no list."), (4, "[1], [2, 3] and [5–7]\nЛитература\n1. A\n2. B\n3. C\n9. D"), (5, ""), (6, "My preferences are [2]: 4. no"),
    (7, "Cites [1-3000000000], [2-9], [7-5] and [3000000002].\nReferences\n4. D\n4000000000. Far\n5. E"), (8, "[5-999999999999999999999] and [9,\n11]\nReferences\n1. A\n[1234567890123456789012] B"),
])

_RANGE = r"^(\d{1,18})\s*[-–—]\s*(\d{1,18})$"


def _expand(other: str) -> str:
    a, b = (f"CAST(regexp_extract(p, '{_RANGE}', {i}) AS BIGINT)" for i in (1, 2))
    return f"CASE WHEN regexp_matches(p, '{_RANGE}') THEN CASE WHEN {a} > {b} THEN [] WHEN {b} - {a} > {t.LONGEST_RANGE} THEN [{a}, {b}] ELSE range({a}, {b} + 1) END ELSE {other} END"


_NAMED = "list_filter(list_transform(string_split(k, ';'), lambda p: lower(regexp_replace(p, '[^a-zA-Zа-яА-ЯёЁ0-9]', '', 'g'))), lambda p: p <> '')"
_NUMBERED = rf"flatten(list_transform(list_transform(regexp_split_to_array(k, '[,;]'), lambda p: trim(p)), lambda p: CASE WHEN regexp_matches(p, '{_RANGE}') THEN list_transform({_expand('[]')}, lambda n: CAST(n AS VARCHAR)) WHEN regexp_replace(p, '\D', '', 'g') = '' THEN [] ELSE [regexp_replace(p, '\D', '', 'g')] END))"
_KEYS = rf"flatten(list_transform(list_transform(regexp_extract_all(sentence, '\[([^\]]+)\]', 1), lambda k: trim(k)), lambda k: CASE WHEN regexp_matches(k, '[a-zA-Zа-яА-ЯёЁ]') THEN {_NAMED} ELSE {_NUMBERED} END))"


@catalog.add("citation_keys", f"WITH {SENTENCES.sql()} SELECT id, array_to_string({_KEYS}, '|') AS keys FROM s WHERE sentence IS NOT NULL")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SENTENCES.df(spark).where("sentence IS NOT NULL").select("id", F.array_join(citations.keys("sentence"), "|").alias("keys"))


def _header_sql() -> str:
    cases = " ".join(f"WHEN contains(lower(text), '{h}') THEN length(text) - instr(reverse(lower(text)), '{h[::-1]}') - {len(h) - 1}" for h in lx.BIBLIOGRAPHY_HEADERS)
    return f"CASE {cases} ELSE -1 END"


_CUT = f"""{DOCS.sql()}, h AS (SELECT *, {_header_sql()} AS place FROM d),
cut AS (SELECT doc_id, CASE WHEN place < 0 THEN text ELSE substr(text, 1, place) END AS body, CASE WHEN place >= 0 THEN substr(text, place + 1) END AS tail FROM h)"""
_CITED = r"""parts AS (SELECT doc_id, trim(unnest(regexp_split_to_array(k, '[,;]')), E' \t\n\r') AS p FROM (SELECT doc_id, unnest(regexp_extract_all(body, '\[\s*(\d+[\s,;\-–—\d]*)\s*\]', 1)) AS k FROM cut)),
ends AS (SELECT DISTINCT doc_id, CAST(regexp_extract(p, '^\d+') AS HUGEINT) AS a, CAST(regexp_extract(p, '\d+$') AS HUGEINT) AS b FROM parts WHERE regexp_matches(p, '^\d+(\s*[-–—]\s*\d+)?$')),
runs AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY doc_id ORDER BY a, b) AS run FROM (SELECT *, coalesce(a > 1 + max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS gap FROM ends WHERE a <= b)),
cited AS (SELECT doc_id, min(a) AS low, max(b) AS high FROM runs GROUP BY doc_id, run)"""
_LISTED = r"""listed AS (SELECT DISTINCT doc_id, CAST(n AS HUGEINT) AS number FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(tail, '(?:^|\n)\s*(?:\[(\d+)\]|(\d+)\.\s+)', 1), regexp_extract_all(tail, '(?:^|\n)\s*(?:\[(\d+)\]|(\d+)\.\s+)', 2))) AS n FROM cut WHERE tail IS NOT NULL) WHERE n <> '')"""


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers of any length as text, which reads alike everywhere."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@catalog.add("body_citations", f"WITH {_CUT}, {_CITED} SELECT doc_id, CAST(low AS VARCHAR) AS low, CAST(high AS VARCHAR) AS high FROM cited")
def body_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(citations.cited_ranges(DOCS.df(spark)), "low", "high")


@catalog.add("bibliography_numbers", f"WITH {_CUT}, {_LISTED} SELECT doc_id, CAST(number AS VARCHAR) AS number FROM listed")
def bibliography_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(citations.listed_numbers(DOCS.df(spark)), "number")


_START = r"^\s*(?:\[([a-zA-Z0-9_.-]+)\]|([0-9]+)\.\s+)"
_IS_HEADER = " OR ".join(f"contains(lower(line), '{h}')" for h in lx.BIBLIOGRAPHY_HEADERS)


@catalog.add(
    "bibliography_map",
    rf"""WITH {_CUT}, l AS (SELECT doc_id, unnest(string_split(tail, chr(10))) AS line, unnest(range(len(string_split(tail, chr(10))))) AS n FROM cut WHERE tail IS NOT NULL),
k AS (SELECT *, regexp_matches(line, '{_START}') AS opens FROM l WHERE trim(line) <> '' AND NOT (({_IS_HEADER}) AND length(trim(line)) < 30)),
e AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS e, lower(concat(regexp_extract(line, '{_START}', 1), regexp_extract(line, '{_START}', 2))) AS key, CASE WHEN opens THEN trim(regexp_replace(line, '{_START}', '')) ELSE trim(line) END AS part FROM k),
j AS (SELECT doc_id, e, max(key) FILTER (opens) AS entry_key, trim(string_agg(part, ' ' ORDER BY n)) AS entry FROM e WHERE e > 0 GROUP BY doc_id, e)
SELECT doc_id, entry_key, arg_max(entry, e) AS entry FROM j GROUP BY doc_id, entry_key""",
)
def bibliography_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.bibliography(DOCS.df(spark))


#: Of each interval the stretches between listed numbers, and listed numbers in no interval.
_WARNED = """edges AS (SELECT c.doc_id, c.low AS start, c.low - 1 AS e FROM cited c UNION SELECT c.doc_id, c.low, c.high + 1 FROM cited c UNION SELECT c.doc_id, c.low, l.number FROM cited c JOIN listed l ON l.doc_id = c.doc_id AND l.number BETWEEN c.low AND c.high),
stretches AS (SELECT doc_id, e + 1 AS low, lead(e) OVER (PARTITION BY doc_id, start ORDER BY e) - 1 AS high FROM edges WHERE doc_id IN (SELECT doc_id FROM listed)),
w AS (SELECT doc_id, low, high, 'citation_missing_bibliography' AS issue_type, 'high' AS severity FROM stretches WHERE low <= high
UNION ALL SELECT doc_id, number, number, 'citation_unused_bibliography', 'low' FROM listed l WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = l.doc_id AND l.number BETWEEN c.low AND c.high))
SELECT doc_id, CAST(low AS VARCHAR) AS low, CAST(high AS VARCHAR) AS high, issue_type, severity, CAST(-1 - coalesce(CAST(sum(CAST(high - low + 1 AS DECIMAL(38, 0))) OVER (PARTITION BY doc_id ORDER BY issue_type, low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS HUGEINT), 0) AS VARCHAR) AS index FROM w"""


@catalog.add("citation_integrity", f"WITH {_CUT}, {_CITED}, {_LISTED}, {_WARNED}")
def citation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(citations.integrity_ranges(DOCS.df(spark)), "low", "high", "index")


_LINES = """concat('Parts [', l_linenumber, '], [', l_linenumber * 3, '-', l_linenumber * 3 + l_suppkey % 5, ';', l_partkey % 40, ' – ', l_partkey % 37, ']')"""
_ENTRIES = "concat(l_suppkey % 30, '. Supplier ', l_suppkey)"


#: Lines of a task, so that what one task holds doesn't grow with the table.
LINES_A_TASK = 100_000


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each order: its lines cite numbers and ranges, its list names suppliers. Every third has no list."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.repartition(lines.count() // LINES_A_TASK + 1, "l_orderkey")
    lines = lines.selectExpr("l_orderkey", "l_linenumber", f"{_LINES} AS said", f"{_ENTRIES} AS entry")
    texts = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "said", "entry"))).alias("l"))
    text = F.concat(F.array_join(F.transform("l", lambda x: x.said), ".\n"), F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit(".\nReferences\n"), F.array_join(F.transform("l", lambda x: x.entry), "\n"))).otherwise(""))
    return texts.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"))


_ORDER_TEXTS = f"""d AS (SELECT l_orderkey AS doc_id, concat(string_agg({_LINES}, E'.\n' ORDER BY l_linenumber), CASE WHEN l_orderkey % 3 <> 0 THEN concat(E'.\nReferences\n', string_agg({_ENTRIES}, E'\n' ORDER BY l_linenumber)) ELSE '' END) AS text FROM lineitem GROUP BY l_orderkey)"""


@catalog.add("order_citation_integrity", f"WITH {_ORDER_TEXTS}, {_CUT.split(DOCS.sql() + ', ')[1]}, {_CITED}, {_LISTED}, {_WARNED}")
def order_citation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_text(citations.integrity_ranges(order_texts(spark, sf_dir)), "low", "high", "index")


REQUESTS = Rows("req", "id long, key string", [(1, "A1"), (2, "b2"), (3, "c3"), (4, "d4"), (5, "e5"), (6, "B2"), (7, "f6")])
LOCAL = Rows("loc", "key string, snippet string", [("a1", "local text"), ("a1", "more local text")])
CACHE = Rows("cac", "key string, title string", [("b2", "Online title"), ("c3", None)])
BIBTEX = Rows("bt", "key string, title string, author string, year string", [("a1", "Local title", "Smith", "2020"), ("d4", "Wanted", "Doe", "2021"), ("c3", "Failed", "X", "1999")])
ENTRIES = Rows("ent", "key string, entry string", [("d4", "not used"), ("e5", "Entry line of five")])


@catalog.add(
    "reference_cascade",
    f"""WITH {REQUESTS.sql()}, {LOCAL.sql()}, {CACHE.sql()}, {BIBTEX.sql()}, {ENTRIES.sql()},
x AS (SELECT r.id, r.key, l.key IS NOT NULL AS has, c.key IS NOT NULL AS cached, c.title AS ct, b.title AS bt, b.author, b.year, e.entry,
  nullif(trim(concat_ws(' ', b.title, b.author, b.year)), '') AS asked FROM req r LEFT JOIN (SELECT DISTINCT key FROM loc) l ON l.key = lower(r.key) LEFT JOIN cac c ON c.key = lower(r.key) LEFT JOIN bt b ON b.key = lower(r.key) LEFT JOIN ent e ON e.key = lower(r.key))
SELECT id, key, CASE WHEN has THEN 'local' WHEN ct IS NOT NULL THEN 'online' ELSE 'unknown' END AS source, coalesce(CASE WHEN has THEN bt ELSE ct END, 'reference ' || key) AS title,
coalesce(CASE WHEN has THEN author END, '') AS author, coalesce(CASE WHEN has THEN year END, '') AS year, CASE WHEN NOT has AND NOT cached THEN coalesce(asked, entry) END AS lookup FROM x""",
)
def reference_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.resolved(*[r.df(spark) for r in (REQUESTS, LOCAL, CACHE, BIBTEX, ENTRIES)])


# --- classifiers ---------------------------------------------------------------------------------------------

STYLE = Rows("f", "id long, nv double, words long, verbs long, sentence string", [
    (1, 5.2, 10, 1, "x"), (2, 2.0, 12, 0, "y"), (3, 1.0, 5, 1, "формула __PROTECTED_LATEX__ дана"), (4, 1.0, 5, 1, "__PROTECTED_LATEX__, где x"), (5, 4.5, 8, 0, "z"),
])
_EXPLAINED = " OR ".join(f"contains(lower(sentence), '{w}')" for w in lx.FORMULA_WORDS)


@catalog.add(
    "translationese_checks",
    f"""WITH {STYLE.sql()}, w AS (SELECT id, unnest(list_filter([CASE WHEN nv > 4.5 THEN 'translationese_noun_stacking:medium' END, CASE WHEN verbs = 0 AND words > 8 THEN 'translationese_verb_deficiency:medium' END,
CASE WHEN contains(sentence, '__PROTECTED_LATEX') AND NOT ({_EXPLAINED}) THEN 'style_formula_unexplained:low' END], lambda x: x IS NOT NULL)) AS w FROM f)
SELECT id, split_part(w, ':', 1) AS issue_type, split_part(w, ':', 2) AS severity FROM w""",
)
def translationese_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = verdict.style_warnings(F.col("nv"), F.col("words"), F.col("verbs"), F.col("sentence"))
    return STYLE.df(spark).select("id", F.explode(w).alias("w")).select("id", "w.*")


REFERENCES = Rows("refs", "id long, entry string", [
    (1, "Иванов И.И. О методе // Вестник. 2020. Т. 5, № 2. С. 10–15."), (2, "Иванов И.И. О методе // Вестник."), (3, "Петров П. Книга о науке"),
    (4, "Smith J. Book. London : Press, 2019. 250 p."), (5, "Site name. URL: http://x.y (дата обращения: 11.06.2026). 2021. С. 3"), (6, "Site  name - url: x"), (7, ""), (8, "  "),
])
_ONLINE = "(contains(lower(e), 'url:') OR contains(lower(e), 'doi:') OR contains(lower(e), 'http'))"
_GOST = f"""{REFERENCES.sql()}, e AS (SELECT id, trim(entry) AS e FROM refs), x AS (SELECT id, e, CASE WHEN e = '' THEN [] ELSE list_filter([
CASE WHEN NOT regexp_matches(e, '{classify.YEAR}') THEN 'year' END, CASE WHEN NOT regexp_matches(e, '{classify.PAGES}') THEN 'pages' END,
CASE WHEN contains(e, '//') AND NOT regexp_matches(e, '{classify.VOLUME}') THEN 'volume' END, CASE WHEN NOT contains(e, '//') AND NOT {_ONLINE} AND NOT regexp_matches(e, '{classify.CITY}') THEN 'city' END,
CASE WHEN {_ONLINE} AND NOT regexp_matches(e, '{classify.ACCESSED}') THEN 'access_date' END, CASE WHEN contains(e, '  ') THEN 'double_space' END], lambda v: v IS NOT NULL) END AS errors FROM e),
g AS (SELECT id, array_to_string(errors, '|') AS errors, greatest(40, 100 - coalesce(CAST(list_sum(list_transform(errors, lambda v: CASE v WHEN 'year' THEN 25 WHEN 'city' THEN 10 WHEN 'double_space' THEN 5 ELSE 15 END)) AS INTEGER), 0)) AS score, replace(regexp_replace(e, '\\s+', ' ', 'g'), ' - ', ' – ') AS corrected FROM x)"""


@catalog.add("gost_score", f"WITH {_GOST} SELECT id, errors, score, corrected FROM g")
def gost_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.format_scores(REFERENCES.df(spark)).select("id", F.array_join("errors", "|").alias("errors"), "score", "corrected")


@catalog.add("gost_average", f"WITH {_GOST} SELECT coalesce(avg(score), 100.0) AS average, count(*) AS n FROM g")
def gost_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gost_score(spark, sf_dir).agg(F.coalesce(F.avg("score"), F.lit(100.0)).alias("average"), F.count(F.lit(1)).alias("n"))


MANUSCRIPTS = Rows("man", "id long, text string, code string", [
    (1, "Введение. АКТУАЛЬНОСТЬ ТЕМЫ исследования. Научная новизна и задачи  исследования.", "2.3.1"), (2, "Nothing here", "9.9.9"), (3, "Апробация результатов. На защиту\nвыносятся", None),
])


@catalog.add(
    "vak_sections",
    f"WITH {MANUSCRIPTS.sql()}, x AS (SELECT id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS low FROM man), sec(section, alts) AS (VALUES "
    + ", ".join(f"('{n}', {sql_list(a)})" for n, a in lx.SECTIONS)
    + ") SELECT id, section, CASE WHEN len(list_filter(alts, lambda a: contains(low, a))) > 0 THEN 'passed' ELSE 'missing' END AS status FROM x CROSS JOIN sec",
)
def vak_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.section_status(MANUSCRIPTS.df(spark), "id", "text")


TOPICS = Rows("topics", "id long, topic string", [(1, "Системный анализ и управление процессами обработки информации"), (2, "численных методов сходимости исследование"), (3, "wholly unrelated"), (4, "криптографических методов защиты информации")])
_SPEC = lx.specialties()
SPECIALTIES = Rows("spec", "ord int, code string, positive string, negative string, publications int", [
    (i, s["code"], f"{s['name_ru']} {s['passport_summary']}", " ".join(s.get("out_of_scope", [])), s["publications_min"]) for i, s in enumerate(_SPEC)
])
_LONG = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[а-яёa-z0-9]{{3,}}'))"


@catalog.add(
    "specialty_map",
    f"""WITH {TOPICS.sql()}, {SPECIALTIES.sql()}, sp AS (SELECT ord, code, {_LONG('positive')} AS p, {_LONG('negative')} AS n FROM spec), tp AS (SELECT id, {_LONG('topic')} AS w FROM topics),
x AS (SELECT id, ord, code, greatest(len(list_intersect(w, p)) - 2 * len(list_filter(list_intersect(w, n), lambda v: NOT list_contains(p, v))), 0) AS score FROM tp CROSS JOIN sp),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS k FROM x)
SELECT id, code, CAST(score AS INTEGER) AS score, least(9, 3 + score) / 10 AS confidence FROM r WHERE k = 1""",
)
def specialty_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.specialty_map(TOPICS.df(spark), "id", "topic", SPECIALTIES.df(spark))


@catalog.add("specialty_lookup", f"WITH {MANUSCRIPTS.sql()}, {SPECIALTIES.sql()} SELECT id, coalesce(s.code, f.code) AS code, coalesce(s.publications, f.publications) AS publications_min FROM man LEFT JOIN spec s ON s.code = man.code CROSS JOIN (SELECT * FROM spec WHERE ord = 0) f")
def specialty_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SPECIALTIES.df(spark)
    first = spec.where("ord = 0").select(F.col("code").alias("_c"), F.col("publications").alias("_p"))
    found = MANUSCRIPTS.df(spark).select("id", F.col("code").alias("_code")).join(F.broadcast(spec), F.col("_code") == F.col("code"), "left").crossJoin(F.broadcast(first))
    return found.select("id", F.coalesce("code", "_c").alias("code"), F.coalesce("publications", "_p").alias("publications_min"))


CLAIMS = Rows("claims", "id long, sentence string", [
    (1, "Общее утверждение без ссылок"), (2, "Это известно давно [1]"), (3, "Анализ показывает рост"), (4, "Впервые предложить метод"), (5, "Очевидный известный факт"), (6, "Эксперимент дал свойство"),
])


def _ordered(classes, default: str, low: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({low}, '{w}')" for w in ws) + f" THEN '{c}'" for c, ws in classes) + f" ELSE '{default}' END"


@catalog.add("claim_types", f"WITH {CLAIMS.sql()} SELECT id, array_to_string({_KEYS}, '|') AS keys, CASE WHEN len({_KEYS}) > 0 THEN 'cited_assertion' ELSE {_ordered([('scientific_inference', lx.INFERENCE_MARKERS)], 'general_statement', 'lower(sentence)')} END AS claim_type FROM claims")
def claim_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = citations.keys("sentence")
    return CLAIMS.df(spark).select("id", F.array_join(keys, "|").alias("keys"), classify.claim_type(keys, F.lower("sentence")).alias("claim_type"))


@catalog.add("evidence_need", f"WITH {CLAIMS.sql()} SELECT id, CASE WHEN len({_KEYS}) > 0 THEN 'already_supported' ELSE {_ordered(lx.EVIDENCE_LEMMAS, 'medium', 'lower(sentence)')} END AS need_level FROM claims")
def evidence_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CLAIMS.df(spark).select("id", classify.evidence_need(citations.keys("sentence"), F.lower("sentence")).alias("need_level"))


ASKED = Rows("asked", "id long, request string", [(1, "Check my GOST references"), (2, "Plan the Chapter outline"), (3, "обзор диссертаций"), (4, "polish this"), (5, "сравни план и ссылки")])
_WORD = "coalesce(" + ", ".join(f"list_filter({sql_list(ws)}, lambda w: contains(lower(request), w))[1]" for _, ws in lx.WORKFLOWS) + ")"


@catalog.add("workflow_route", f"WITH {ASKED.sql()} SELECT id, {_ordered(lx.WORKFLOWS, lx.DEFAULT_WORKFLOW, 'lower(request)')} AS workflow, {_WORD} AS keyword FROM asked")
def workflow_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow, word = classify.workflow(F.lower("request"))
    return ASKED.df(spark).select("id", flow.alias("workflow"), word.alias("keyword"))


# --- gates and folds -----------------------------------------------------------------------------------------

GATES = Rows("g", "id long, is_bibliography boolean, triggered boolean, is_gap boolean, has_model boolean, head_ppl double, ppl double, ppl_low double, ppl_high double", [
    (1, True, False, False, True, 40.0, 40.0, 15.0, 80.0), (2, False, False, False, True, 40.123, 41.0, 15.0, 80.0), (3, False, False, True, True, 5.0, 6.0, 15.0, 80.0),
    (4, False, True, False, True, 40.0, 41.456, 15.0, 80.0), (5, False, False, False, True, 100.0, 50.0, 15.0, 80.0), (6, False, False, False, False, None, None, 15.0, 80.0),
    (7, False, True, False, False, None, None, 15.0, 80.0), (8, False, False, True, True, 30.0, 30.0, 15.0, 80.0), (9, False, False, False, True, 90.0, 90.5, 15.0, 80.0),
])
_EARLY = "(has_model AND NOT triggered AND head_ppl BETWEEN ppl_low AND ppl_high)"


@catalog.add(
    "gates_local",
    f"""WITH {GATES.sql()}, x AS (SELECT *, CASE WHEN has_model AND NOT is_bibliography THEN CASE WHEN {_EARLY} THEN head_ppl ELSE ppl END END AS used FROM g)
SELECT id, CASE WHEN is_bibliography THEN 'bibliography' WHEN {_EARLY} THEN 'early_exit' WHEN is_gap THEN 'citation_gap' WHEN triggered OR (has_model AND (ppl < ppl_low OR ppl > ppl_high)) THEN 'judge' ELSE 'passed' END AS route,
round(used, 2) AS ppl2, CASE WHEN used IS NOT NULL THEN CASE WHEN {_EARLY} THEN 'prefix' ELSE 'sentence' END END AS ppl_basis FROM x""",
)
def gates_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.local_route(GATES.df(spark)).select("id", "route", "ppl2", "ppl_basis")


@catalog.add(
    "gates_cloud",
    f"WITH {GATES.sql()}, x AS (SELECT *, CASE WHEN is_bibliography THEN 'bibliography' WHEN is_gap THEN 'citation_gap' ELSE 'judge' END AS route FROM g) SELECT id, 'hybrid' AS engine, route, CASE WHEN has_model AND route = 'judge' THEN round(ppl, 2) END AS ppl2 FROM x UNION ALL SELECT id, 'cloud', route, NULL FROM x",
)
def gates_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = [verdict.remote_route(GATES.df(spark), p).select("id", F.lit(n).alias("engine"), "route", "ppl2") for n, p in (("hybrid", True), ("cloud", False))]
    return each[0].unionByName(each[1])


VERDICTS = Rows("v", "id long, found string, ppl2 double, ppl_low double", [
    (1, "", 7.5, 15.0), (2, "", 40.0, 15.0), (3, "style_a|style_b", 7.5, 15.0), (4, "api_request_error", 40.0, 15.0), (5, "style_a|json_parse_error", None, 15.0), (6, "", None, 15.0), (7, "json_parse_error|style_a", 3.0, 15.0),
])


def _issues(column: str) -> F.Column:
    kinds = F.filter(F.split(column, r"\|"), lambda x: x != "")
    return F.transform(kinds, lambda k: F.struct(k.alias("issue_type"), F.lit("medium").alias("severity")))


def _kinds(column: str):
    return F.array_join(F.transform(column, lambda i: i["issue_type"]), "|")


@catalog.add(
    "verdict_fold",
    f"""WITH {VERDICTS.sql()}, x AS (SELECT id, CASE WHEN found = '' AND ppl2 < ppl_low THEN ['ai_generated_suspicion'] ELSE list_filter(string_split(found, '|'), lambda k: k <> '') END AS l FROM v),
y AS (SELECT id, l, l[1] AS issue_type, coalesce(l[1] IN ('api_request_error', 'json_parse_error'), false) AS judge_error FROM x)
SELECT id, issue_type, judge_error, CASE WHEN judge_error OR len(l) = 0 THEN 'passed' ELSE 'flagged' END AS status, CASE WHEN judge_error THEN '' ELSE coalesce(array_to_string(list_filter(l, lambda k: k NOT IN ('api_request_error', 'json_parse_error')), '|'), '') END AS issues FROM y""",
)
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = VERDICTS.df(spark).withColumn("found", _issues("found"))
    return verdict.folded(rows).select("id", "issue_type", "judge_error", "status", _kinds("issues").alias("issues"))


AUDITS = Rows("a", "id long, status string, issue_type string, issues string, audits string", [
    (1, "passed", None, "", "SUPPORTED"), (2, "flagged", "style_a", "style_a|citation_gap", "SUPPORTED|NOT_ENOUGH_INFO|CONTRADICTED"), (3, "passed", None, "", "AUDIT_FAILED|CONTRADICTED"), (4, "flagged", "style_a", "style_a", ""),
])


@catalog.add(
    "audit_fold",
    f"""WITH {AUDITS.sql()}, x AS (SELECT *, list_filter(string_split(audits, '|'), lambda s: s IN ('CONTRADICTED', 'NOT_ENOUGH_INFO'))[1] AS f, list_filter(string_split(issues, '|'), lambda k: k <> '') AS l FROM a),
y AS (SELECT *, CASE f WHEN 'NOT_ENOUGH_INFO' THEN 'citation_gap' WHEN 'CONTRADICTED' THEN 'citation_contradiction' END AS k FROM x)
SELECT id, CASE WHEN k IS NOT NULL THEN 'flagged' ELSE status END AS status, coalesce(k, issue_type) AS issue_type, coalesce(array_to_string(CASE WHEN k IS NULL THEN l ELSE list_concat([k], list_filter(l, lambda i: i <> k)) END, '|'), '') AS issues FROM y""",
)
def audit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = AUDITS.df(spark).withColumn("issues", _issues("issues")).withColumn("audits", F.split("audits", r"\|"))
    return verdict.audited(rows).select("id", "status", "issue_type", _kinds("issues").alias("issues"))


# --- issues derived from the driver's documents -------------------------------------------------------------

_DERIVED = f"""{FEATURES}, results AS (SELECT doc_id, sent_idx, sentence, list_filter([CASE WHEN nv100 > 350 THEN 'nominal_style' END, CASE WHEN n_cliches > 0 THEN 'cliche' END, CASE WHEN n_words > 25 THEN 'ai_generated_suspicion' END], lambda x: x IS NOT NULL) AS kinds,
n_words = 1 AS judge_error FROM feat), r AS (SELECT *, CASE WHEN len(kinds) > 0 THEN 'flagged' ELSE 'passed' END AS status FROM results)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    kinds = F.array_compact(F.array(F.when(F.col("nv_ratio") > 3.5, "nominal_style"), F.when(F.col("n_cliches") > 0, "cliche"), F.when(F.col("n_words") > 25, "ai_generated_suspicion")))
    df = df.select("doc_id", "sent_idx", "sentence", kinds.alias("issue_types"), (F.col("n_words") == 1).alias("judge_error"))
    return df.withColumn("status", F.when(F.size("issue_types") > 0, "flagged").otherwise("passed")).withColumn("is_integrity", F.lit(False))


@catalog.add("issue_breakdown", f"WITH {_DERIVED} SELECT kind AS issue_type, count(*) AS n FROM (SELECT unnest(list_distinct(kinds)) AS kind FROM r WHERE status = 'flagged') GROUP BY kind")
def issue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = results(spark, sf_dir).where("status = 'flagged'").select(F.explode(F.array_distinct("issue_types")).alias("issue_type"))
    return each.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "issue_type")


@catalog.add(
    "tab_counts",
    f"""WITH {_DERIVED}, tabs AS (SELECT unnest(list_filter(['all', CASE WHEN judge_error AND status <> 'flagged' THEN 'unjudged' END, CASE WHEN status <> 'flagged' AND NOT judge_error THEN 'passed' END,
CASE WHEN list_contains(kinds, 'ai_generated_suspicion') THEN 'ai' END, CASE WHEN len(list_filter(kinds, lambda k: k <> 'ai_generated_suspicion')) > 0 THEN 'flagged' END], lambda x: x IS NOT NULL)) AS tab FROM r) SELECT tab, count(*) AS n FROM tabs GROUP BY tab""",
)
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return rows.select(F.explode(verdict.tabs(rows)).alias("tab")).groupBy("tab").agg(F.count(F.lit(1)).alias("n"))


@catalog.add("card_filter", f"WITH {_DERIVED} SELECT doc_id, sent_idx FROM r WHERE list_contains(kinds, 'cliche') AND contains(lower(sentence), 'tion')")
def card_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array_contains("issue_types", "cliche") & F.lower("sentence").contains("tion")
    return results(spark, sf_dir).where(wanted).select("doc_id", "sent_idx")


@catalog.add(
    "run_summary",
    f"WITH {_DERIVED} SELECT doc_id, count(*) AS total, count(*) FILTER (NOT (judge_error AND status <> 'flagged')) AS completed, count(*) FILTER (status = 'flagged') AS flagged, CAST(floor(100.0 * count(*) FILTER (status = 'flagged') / count(*) + 0.5) AS BIGINT) AS flagged_percent FROM r GROUP BY doc_id",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.count_if(F.col("status") == "flagged")
    return results(spark, sf_dir).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~(F.col("judge_error") & (F.col("status") != "flagged"))).alias("completed"), flagged.alias("flagged"), F.floor(100.0 * flagged / F.count(F.lit(1)) + 0.5).alias("flagged_percent")
    )
