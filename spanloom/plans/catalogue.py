"""All queries over the annotation operators, by name, with the SQL that each must equal.

The driver's tables stand for the relations: documents with labels for sentences of two classes, line items of a part for
repeated annotations of a sentence, embeddings for vectors, events for an append-only log, orders for targets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import phrases
from spanloom.functions import text as T
from spanloom.functions.rows import exploded, once
from spanloom.operators import answers, assemble, checks, consensus, diagnostics, draws, gate, hashtree, interaction, metrics, results, retrieval, rounds, spans, termstats
from spanloom.plans import protocol
from spanloom.sources import model, relations, shared
from spanloom.streaming import log, machine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WORD = "[A-Za-zÀ-ÿ]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- scans, keys, coverage


@query("SELECT l.doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'negative' END AS status, lang, n_chars FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 0")
def scan_filter_project(spark, d):
    rows = t(spark, d, "labels").where("toxic = 0").join(t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("negative").alias("status"), "lang", "n_chars")


@query("SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY ALL HAVING count(*) > 1 OR user_id IS NULL OR event_type IS NULL")
def pk_violations(spark, d):
    return checks.key_violations(t(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""SELECT doc_id, 'left' AS only_in FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def coverage_violations(spark, d):
    return checks.coverage(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"])


@query("""SELECT vec_id, CAST(len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0 AS INTEGER) AS vector_ok,
CAST(regexp_matches(sha256(CAST(vec_id AS VARCHAR)), '^[0-9a-f]{64}$') AS INTEGER) AS sha_ok, CAST(1 AS INTEGER) AS identity_ok FROM embeddings""")
def row_predicates(spark, d):
    rows = t(spark, d, "embeddings").withColumn("sha", F.sha2(F.col("vec_id").cast("string"), 256))
    ok = (checks.finite_vector_ok("embedding", 64), checks.sha256_ok("sha"), checks.identity_ok("vec_id", "label"))
    return rows.select("vec_id", *(c.cast("int").alias(n) for c, n in zip(ok, ("vector_ok", "sha_ok", "identity_ok"), strict=True)))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS negative,
count(*) FILTER (WHERE quality IS NULL) AS excluded FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def corpus_split_counts(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    q = F.col("quality")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(q == 1).alias("accepted"), F.count_if(q == 0).alias("negative"), F.count_if(q.isNull()).alias("excluded"))


@query("""SELECT event_id, CAST(json_keys(props) = ['k'] AS INTEGER) AS exact, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_exact_keys(spark, d):
    return t(spark, d, "events").select("event_id", checks.exact_keys("props", ["k"]).cast("int").alias("exact"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, sha256(text) AS sentence_sha256, CAST(length(text) AS INTEGER) AS chars FROM documents")
def sentence_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sentence_sha256"), F.length("text").alias("chars"))


# --- text and spans


def tagged(docs: DataFrame) -> DataFrame:
    """Words of twelve letters or more become tagged spans."""
    return docs.select("doc_id", "text", F.regexp_replace("text", "([A-Za-zÀ-ÿ]{12,})", "<skill>$1</skill>").alias("tagged"))


_TAGGED_SQL = """
tagged AS (SELECT doc_id, regexp_replace(text, '([A-Za-zÀ-ÿ]{12,})', '<skill>\\1</skill>', 'g') AS tagged FROM documents),
parts AS (SELECT doc_id, unnest(str_split(tagged, '<skill>')) AS part, generate_subscripts(str_split(tagged, '<skill>'), 1) AS k FROM tagged),
placed AS (SELECT doc_id, k, CASE WHEN k > 1 THEN str_split(part, '</skill>')[1] END AS word, length(replace(part, '</skill>', '')) AS size,
  sum(length(replace(part, '</skill>', ''))) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM parts)
"""


@query(f"""WITH {_TAGGED_SQL} SELECT doc_id, CAST(upto - size AS INTEGER) AS start, CAST(upto - size + length(word) AS INTEGER) AS "end", word AS text FROM placed WHERE k > 1""")
def tag_scan(spark, d):
    scanned = tagged(t(spark, d, "documents")).select("doc_id", spans.scan_tags(F.col("tagged"), "skill").alias("s"))
    return exploded(scanned, F.col("s.spans"), "span", "doc_id").select("doc_id", "span.start", "span.end", "span.text")


@query("SELECT doc_id, ['nested', 'unclosed', 'unmatched', 'empty', NULL][doc_id % 5 + 1] AS error, CAST(doc_id % 5 IN (1, 4) AS INTEGER) AS n_spans FROM documents")
def tag_errors(spark, d):
    """Each kind of error, one of them behind a good span, and none."""
    docs, kind, text = t(spark, d, "documents"), F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    broken = (
        F.when(kind == 0, F.concat(F.lit("<skill>a<skill>"), text)).when(kind == 1, F.concat(F.lit("<skill>a</skill>"), text, F.lit("<skill>b")))
        .when(kind == 2, F.concat(F.lit("a</skill>"), text)).when(kind == 3, F.concat(F.lit("<skill></skill>"), text)).otherwise(F.concat(F.lit("<skill>a</skill>"), text))
    )
    scanned = docs.select("doc_id", spans.scan_tags(broken, "skill").alias("s"))
    return scanned.select("doc_id", "s.error", F.size("s.spans").alias("n_spans"))


@query(f"""WITH {_TAGGED_SQL}, words AS (SELECT doc_id, list(struct_pack(s := upto - size, w := word) ORDER BY k) AS ws FROM placed WHERE k > 1 GROUP BY doc_id)
SELECT doc_id, CASE WHEN ws IS NULL THEN sha256(text) ELSE sha256(list_reduce(list_prepend(text, list_transform(ws, lambda w: CAST(w.s AS VARCHAR) || ':' || length(w.w))),
  lambda acc, x: left(acc, CAST(str_split(x, ':')[1] AS BIGINT)) || repeat(' ', CAST(str_split(x, ':')[2] AS BIGINT)) || substr(acc, CAST(str_split(x, ':')[1] AS BIGINT) + CAST(str_split(x, ':')[2] AS BIGINT) + 1))) END AS masked_sha256
FROM documents LEFT JOIN words USING (doc_id)""")
def masked_text(spark, d):
    scanned = once(tagged(t(spark, d, "documents")), spans.scan_tags(F.col("tagged"), "skill")["spans"], "s", "doc_id", "text")
    return scanned.select("doc_id", F.sha2(spans.mask(F.col("text"), F.col("s")), 256).alias("masked_sha256"))


@query(f"WITH {_TAGGED_SQL} SELECT d.doc_id, CAST(1 AS INTEGER) AS exact, CAST(count(word) = 0 AS INTEGER) AS shifted_ok FROM documents d LEFT JOIN placed USING (doc_id) GROUP BY d.doc_id")
def span_predicates(spark, d):
    s = once(tagged(t(spark, d, "documents")), spans.scan_tags(F.col("tagged"), "skill")["spans"], "s", "doc_id", "text")
    moved = F.transform("s", lambda x: F.struct(x["text"].alias("text"), (x["start"] + 1).alias("start"), (x["end"] + 1).alias("end")))
    return s.select("doc_id", spans.span_set_ok(F.col("text"), F.col("s")).cast("int").alias("exact"), spans.span_set_ok(F.col("text"), moved).cast("int").alias("shifted_ok"))


@query("""SELECT doc_id, sha256(text) AS recovered_sha256, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS substituted
FROM (SELECT doc_id, replace(text, '–', 'e') AS text FROM documents)""")
def recover_char_projection(spark, d):
    damaged = F.regexp_replace(F.replace(F.col("text"), F.lit("–"), F.lit("e")), "e", "\u0096")
    fixed = F.replace(T.recovered(F.col("damaged")), F.lit("–"), F.lit("e"))
    return t(spark, d, "documents").select("doc_id", damaged.alias("damaged")).select("doc_id", F.sha2(fixed, 256).alias("recovered_sha256"), T.substitutions(F.col("damaged")).alias("substituted"))


#: What Java's Unicode \\w has, spelled for the SQL's matcher.
_SQL_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"


@query("""WITH damaged AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', chr(150)) WHEN 2 THEN text || '!' ELSE replace(text, 'a', chr(150)) END AS text,
CASE doc_id % 4 WHEN 1 THEN replace(text, 'e', '–') ELSE text END AS copy FROM documents)
SELECT doc_id, CASE WHEN text = copy THEN 'unchanged' WHEN length(text) <> length(copy) THEN 'length_changed' WHEN doc_id % 4 = 3 THEN 'character_changed' END AS reason,
CAST(CASE WHEN length(text) = length(copy) THEN length(text) - length(replace(text, chr(150), '')) ELSE 0 END AS INTEGER) AS substituted,
CASE WHEN text <> copy AND doc_id % 4 = 1 THEN substr(text, 1, 9) END AS span FROM damaged""")
def projected_spans(spark, d):
    """A span of nine characters carried over to sentences with control marks; copies that are equal, longer, or differ otherwise have a reason."""
    kind = F.col("doc_id") % 4
    dash, mark = F.lit("–"), F.lit("\u0096")
    swap = lambda c, x: F.replace("text", F.lit(c), x)
    sentence = F.when(kind == 0, F.col("text")).when(kind == 1, swap("e", mark)).when(kind == 2, F.concat("text", F.lit("!"))).otherwise(swap("a", mark))
    copy = F.when(kind == 1, swap("e", dash)).otherwise(F.col("text"))
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(9).alias("end")))
    p = once(t(spark, d, "documents"), T.projection(sentence, copy, span), "p", "doc_id")
    return p.select("doc_id", "p.reason", F.size("p.substitutions").alias("substituted"), F.get("p.spans", F.lit(0))["text"].alias("span"))


@query(rf"""WITH bank AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{7,}}')) AS w FROM benchmark),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{_SQL_WORD}]+')) AS w FROM documents),
n AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS d FROM words SEMI JOIN bank USING (w) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_matches, CAST(coalesce(d, 0) AS INTEGER) AS n_phrases FROM documents LEFT JOIN n USING (doc_id)""")
def phrase_matches(spark, d):
    """All long words of the benchmark, found in all documents in one pass."""
    words = exploded(t(spark, d, "benchmark"), F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)), "w")
    bank = phrases.Sent(words, "w", words=True)
    found = once(t(spark, d, "documents"), phrases.matches(F.col("text"), bank), "m", "doc_id")
    return found.select("doc_id", F.size("m").alias("n_matches"), F.size(F.array_distinct(F.transform("m", lambda x: x["phrase"]))).alias("n_phrases"))


@query("""SELECT doc_id, x.text AS text, CAST(x.place AS INTEGER) AS place, CAST(x.text IN ('the', 'And') AS INTEGER) AS in_bank, CAST(lower(x.text) IN ('the', 'and') AS INTEGER) AS in_bank_folded,
CAST(contains(text, x.text) AS INTEGER) AS in_text, CAST(contains(lower(text), lower(x.text)) AS INTEGER) AS in_text_folded
FROM (SELECT doc_id, text, unnest([{'text': 'the', 'place': 1}, {'text': 'AND', 'place': 2}, {'text': 'qu', 'place': 3}, {'text': 'zzzz', 'place': 4}]) AS x FROM documents WHERE doc_id % 3 > 0)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 3 = 0""")
def feature_flags(spark, d):
    """A list of features told against a bank and each document; every third list is invalid."""
    docs, bank = t(spark, d, "documents"), phrases.Sent(spark.createDataFrame([("the",), ("And",)], "w string"), "w")
    content = F.when(F.col("doc_id") % 3 == 0, '{"trfs": ["the", " "]}').otherwise('{"trfs": [" the ", "AND", "the", "qu", "\uff5a\uff5a\uff5a\uff5a"]}')
    found = once(docs, phrases.features(content, F.col("text"), bank), "p", "doc_id")
    rows = found.select("doc_id", F.explode_outer("p.features").alias("x"))
    return rows.select("doc_id", "x.text", "x.place", *(F.col(f"x.{c}").cast("int").alias(c) for c in ("in_bank", "in_bank_folded", "in_text", "in_text_folded")))


@query(rf"SELECT doc_id, CAST(regexp_matches(text, '(?i)(^|[^{_SQL_WORD}])the[\s\p{{Z}}]+and($|[^{_SQL_WORD}])') AS INTEGER) AS has_phrase FROM documents")
def phrase_contains(spark, d):
    return t(spark, d, "documents").select("doc_id", interaction.contains_phrase(F.col("text"), F.lit("the and")).cast("int").alias("has_phrase"))


#: Ways to spoil an answer on features, by the rule that each breaks: where, and what stands there. The first is none.
FEATURE_FAULTS = [
    (None, None, None), ("json", "$", None), ("value", "$.revised_entity_types[0]", ("revised_entity_types", ["Job"])), ("missing", "$.overall_reason", None), ("unknown", "$.more", ("more", 1)),
    ("type", "$.original_trf_decisions[0].confidence", ("confidence", True)), ("range", "$.original_trf_decisions[0].confidence", ("confidence", 6)), ("value", "$.original_trf_decisions[0].action", ("action", "stay")),
    ("repeated", "$.original_trf_decisions[0].reason_codes", ("reason_codes", ["TOO_GENERIC", "TOO_GENERIC"])), ("size", "$.original_trf_decisions[0].evidence_sources", ("evidence_sources", [])),
    ("length", "$.original_trf_decisions[0].reason", ("reason", "x" * 241)), ("blank", "$.original_trf_decisions[0].reason", ("reason", " ")), ("unknown_demo", "$.original_trf_decisions[0]", ("evidence_demo_ids", [77])),
    ("ids_without_source", "$.original_trf_decisions[0]", ("evidence_sources", ["TARGET_TEXT"])), ("source_without_ids", "$.original_trf_decisions[0]", ("evidence_demo_ids", [])), ("order", "$.original_trf_decisions", ("normalized_text", "another")),
    ("must_be_dropped", "$.original_trf_decisions[1]", None), ("excluded", "$.added_trfs[0]", ("text", "Slowly")), ("labelled_class", "$.added_trfs[0]", ("text", "python")), ("repeated_feature", "$.added_trfs[0]", ("text", "FIRST one")),
]


def _feature_answer(fault: tuple) -> str:
    """An answer with just this fault."""
    import json

    rule, at, change = fault
    cite = {"confidence": 3, "evidence_sources": ["EXEMPLARS"], "evidence_demo_ids": [1], "reason_codes": ["EXEMPLAR_SUPPORT"], "reason": "why"}
    decisions = [{"normalized_text": "first one", "action": "keep", **cite}, {"normalized_text": "quickly", "action": "keep" if rule == "must_be_dropped" else "drop", **cite}]
    answer = {"revised_entity_types": ["Skill"], "original_trf_decisions": decisions, "added_trfs": [{"text": "new one", "semantic_class": "skill_type_cue", **cite}], "overall_reason": "all", "unresolved_issues": []}
    if change:
        into = decisions[0] if at.startswith("$.original") else answer["added_trfs"][0] if at.startswith("$.added") else answer
        into[change[0]] = change[1]
    if rule == "missing":
        del answer["overall_reason"]
    return json.dumps(answer) + " {}" * (rule == "json")


_FAULT_ROWS = ", ".join(f"({k}, '{at}', '{rule}')" for k, (rule, at, _) in enumerate(FEATURE_FAULTS) if rule)


@query(f"""SELECT event_id, f.place AS "at", f.rule AS rule FROM events JOIN (VALUES {_FAULT_ROWS}) f(k, place, rule) ON event_id % {len(FEATURE_FAULTS)} = k""")
def feature_answer_errors(spark, d):
    """Answers in turn without a fault and with one of each kind: each fault is a row, and there are no others."""
    rows = t(spark, d, "events").select("event_id")
    content = F.element_at(F.array(*(F.lit(_feature_answer(f)) for f in FEATURE_FAULTS)), (F.col("event_id") % len(FEATURE_FAULTS) + 1).cast("int"))
    labelled = {"quickly": (False, "descriptive_modifier"), "slowly": (False, "descriptive_modifier"), "python": (True, "domain_feature")}
    found = answers.feature_errors(content, F.lit("a sentence"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), F.array(F.lit("First one"), F.lit("quickly")), labelled)
    return answers.violations(rows.withColumn("errors", found), "event_id")


@query("SELECT doc_id, sha256(replace('Annotate: <sentence_json>', '<sentence_json>', CAST(to_json(text) AS VARCHAR))) AS prompt_sha256 FROM documents")
def prompts(spark, d):
    filled = F.replace(F.lit("Annotate: <sentence_json>"), F.lit("<sentence_json>"), T.json_quoted(F.col("text")))
    return t(spark, d, "documents").select("doc_id", F.sha2(filled, 256).alias("prompt_sha256"))


_CANDIDATES_SQL = """
lines AS (SELECT l_orderkey AS target, l_linenumber AS demo, min(('mode ' || (l_suppkey % 4), CAST(l_quantity AS INTEGER), l_returnflag)) AS x FROM lineitem GROUP BY ALL),
c AS (SELECT target, list({'demo': CAST(demo AS BIGINT), 'sentence': x[1], 'status': CASE x[3] WHEN 'A' THEN 'accepted' ELSE 'negative' END, 'spans': [x[1]]} ORDER BY demo) AS candidates, list_distinct(list(x[1] ORDER BY demo)) AS f FROM lines GROUP BY target)
"""


@query(f"""WITH {_CANDIDATES_SQL}, p AS (SELECT target, 'Judge each candidate.' || chr(10) || CAST(to_json({{'candidates': candidates, 'target': target}}) AS VARCHAR) AS body FROM c)
SELECT target, sha256(body) AS prompt_sha256, CAST(length(body) <= 500 AS INTEGER) AS fits FROM p""")
def judging_prompts(spark, d):
    """A prompt for each target with what may be shown of its candidates: their scores, ranks and roles aren't."""
    state, lines = order_states(spark, d)
    judged = rounds.joined(state.judgments, lines, ["target", "demo"])
    status = F.when(F.col("role") == "supporting", "accepted").otherwise("negative")
    row = F.struct("retrieval_rank", "demo", F.col("text").alias("sentence"), status.alias("status"), F.array("text").alias("spans"), "score")
    rows = judged.groupBy("target").agg(F.sort_array(F.collect_list(row)).alias("candidates"))
    p = protocol.prompt("Judge each candidate.", 500, target=F.col("target"), candidates=protocol.public_examples(F.col("candidates")))
    return once(rows, p, "p", "target").select("target", F.col("p.sha256").alias("prompt_sha256"), F.col("p.fits").cast("int").alias("fits"))


@query()
def nfkc_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(T.nfkc_text(F.col("text")), 256).alias("normalized_sha256"), T.units(F.col("text")).alias("units"))


@query()
def technical_tokens(spark, d):
    docs = t(spark, d, "documents").select("doc_id", T.unigram_tokens(F.col("text")).alias("tokens"), T.offset_tokens(F.col("text")).alias("placed"))
    return docs.select("doc_id", F.size("tokens").alias("n_tokens"), F.size("placed").alias("n_placed"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query()
def edit_summary(spark, d):
    rows = t(spark, d, "benchmark").select("item_id", T.edits(F.col("text"), F.regexp_replace("text", "th", "d")).alias("e"))
    return rows.select("item_id", "e.*")


@query("""SELECT event_id, ['fenced', 'embedded', 'direct'][event_id % 3 + 1] AS method, '{"k": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS object FROM events""")
def lenient_parse(spark, d):
    content = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so: "), "props", F.lit("."))).otherwise(F.col("props"))
    return t(spark, d, "events").select("event_id", T.lenient_json(content).alias("p")).select("event_id", "p.method", "p.object")


@query(f"""WITH {_TAGGED_SQL}, around AS (SELECT doc_id, word, CAST(upto - size AS BIGINT) AS s,
  CAST(coalesce(lag(upto - size + length(word)) OVER w, 0) AS BIGINT) AS before, CAST(coalesce(lead(upto - size) OVER w, length(text)) AS BIGINT) AS behind, text FROM placed JOIN documents USING (doc_id) WHERE k > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
moved AS (SELECT doc_id, bool_or(strpos(substr(text, before + 1, s + length(word) - 1 - before), word) > 0 OR strpos(substr(text, s + 2, behind - s - 1), word) > 0) AS more, count(*) AS n FROM around GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_payloads, CAST(CASE WHEN more OR n IS NULL THEN -1 ELSE n END AS INTEGER) AS n_placed FROM documents LEFT JOIN moved USING (doc_id)""")
def payload_recovery(spark, d):
    """Where a placement isn't the only one, some payload of it can be moved alone, between its neighbours: so the SQL has it."""
    s = once(tagged(t(spark, d, "documents")), F.transform(spans.scan_tags(F.col("tagged"), "skill")["spans"], lambda x: x["text"]), "payloads", "doc_id", "text")
    return s.select("doc_id", F.coalesce(F.size("payloads"), F.lit(0)).alias("n_payloads"), F.coalesce(F.size(T.placed_payloads(F.col("text"), F.col("payloads"))), F.lit(-1)).alias("n_placed"))


# --- term statistics


def classed_tokens(spark, d, masked: bool = False) -> DataFrame:
    rows = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    text = F.when(F.col("quality") == 1, F.regexp_replace("text", "[A-Za-zÀ-ÿ]{12,}", " ")).otherwise(F.col("text")) if masked else F.col("text")
    return exploded(rows, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "token", F.col("doc_id").alias("doc"), (F.col("quality") == 1).alias("pos"))


def class_sizes(spark, d) -> DataFrame:
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id").agg(F.count_if(F.expr("quality = 1")).alias("n_pos"), F.count_if(F.expr("quality = 0")).alias("n_neg"))


def _terms_sql(masked: bool) -> str:
    text = "CASE WHEN quality = 1 THEN regexp_replace(text, '[A-Za-zÀ-ÿ]{12,}', ' ', 'g') ELSE text END" if masked else "text"
    return f"""
toks AS (SELECT doc_id, quality = 1 AS pos, unnest(regexp_extract_all({text}, '{WORD}')) AS token FROM documents JOIN labels USING (doc_id)),
counts AS (SELECT token, CAST(count(*) FILTER (WHERE pos) AS BIGINT) AS raw_pos, CAST(count(*) FILTER (WHERE NOT pos) AS BIGINT) AS raw_neg,
  count(DISTINCT doc_id) FILTER (WHERE pos) AS df_pos, count(DISTINCT doc_id) FILTER (WHERE NOT pos) AS df_neg FROM toks GROUP BY token),
sizes AS (SELECT count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg FROM documents JOIN labels USING (doc_id)),
cells AS (SELECT counts.*, n_pos, n_neg, CAST(n_pos + n_neg AS DOUBLE) AS n, df_pos + df_neg AS p, n_pos + n_neg - df_pos - df_neg AS a FROM counts, sizes),
measured AS (SELECT token, raw_pos, raw_neg, df_pos, df_neg,
  (CASE WHEN df_pos > 0 THEN df_pos / n * ln(df_pos * n / (p * n_pos)) ELSE 0 END) + (CASE WHEN df_neg > 0 THEN df_neg / n * ln(df_neg * n / (p * n_neg)) ELSE 0 END)
  + (CASE WHEN n_pos > df_pos THEN (n_pos - df_pos) / n * ln((n_pos - df_pos) * n / (a * n_pos)) ELSE 0 END)
  + (CASE WHEN n_neg > df_neg THEN (n_neg - df_neg) / n * ln((n_neg - df_neg) * n / (a * n_neg)) ELSE 0 END) AS mi,
  CASE WHEN raw_pos > 0 THEN raw_neg / raw_pos END AS ratio, raw_pos > 0 AND raw_neg / raw_pos <= 3.0 AS eligible,
  raw_pos > 0 AND raw_neg / raw_pos <= 3.0 AND df_pos / n_pos > df_neg / n_neg AS directional FROM cells)
"""


_METRICS = ("token", "raw_pos", "raw_neg", "df_pos", "df_neg")


@query(f"WITH {_terms_sql(False)} SELECT {', '.join(_METRICS)} FROM counts")
def token_doc_freq(spark, d):
    return termstats.exploded_counts(classed_tokens(spark, d)).select(*_METRICS)


@query(f"WITH {_terms_sql(False)} SELECT token, round(mi, 9) AS mi, round(ratio, 9) AS ratio, CAST(eligible AS INTEGER) AS eligible, CAST(directional AS INTEGER) AS directional FROM measured")
def term_mi(spark, d):
    m = termstats.candidate_metrics(termstats.exploded_counts(classed_tokens(spark, d)), class_sizes(spark, d))
    return m.select("token", F.round("mi", 9).alias("mi"), F.round("ratio", 9).alias("ratio"), F.col("eligible").cast("int").alias("eligible"), F.col("directional").cast("int").alias("directional"))


def _bank_sql(masked: bool) -> str:
    return f"""WITH {_terms_sql(masked)} SELECT token, round(mi, 9) AS mi, df_pos, CAST(row_number() OVER (ORDER BY measured.mi DESC, df_pos DESC, token) AS INTEGER) AS rank
FROM measured WHERE directional QUALIFY rank <= 20"""


@query(_bank_sql(False))
def term_bank_topn(spark, d):
    return termstats.bank(termstats.candidate_metrics(termstats.exploded_counts(classed_tokens(spark, d)), class_sizes(spark, d))).select("token", F.round("mi", 9).alias("mi"), "df_pos", "rank")


@query(_bank_sql(True))
def term_bank_masked(spark, d):
    return termstats.bank(termstats.candidate_metrics(termstats.exploded_counts(classed_tokens(spark, d, masked=True)), class_sizes(spark, d))).select("token", F.round("mi", 9).alias("mi"), "df_pos", "rank")


@query(f"""WITH {_terms_sql(False)}, paper AS (SELECT *, row_number() OVER (ORDER BY mi DESC, df_pos DESC, token) AS paper_rank FROM measured WHERE eligible)
SELECT token, round(mi, 9) AS mi, CAST(paper_rank AS INTEGER) AS paper_rank, CAST(CASE WHEN directional THEN count(*) FILTER (WHERE directional) OVER (ORDER BY paper_rank) END AS INTEGER) AS rank FROM paper WHERE paper_rank <= 40""")
def term_paper_ranks(spark, d):
    m = termstats.candidate_metrics(termstats.exploded_counts(classed_tokens(spark, d)), class_sizes(spark, d))
    return termstats.paper_bank(m, 40).select("token", F.round("mi", 9).alias("mi"), "paper_rank", "rank")


# --- consensus


def annotated(spark, d) -> DataFrame:
    """idx, sample, valid, has, spans: a part's lines of one number are a sample, those returned its spans."""
    of = lambda column, unit: F.floor(F.round(F.col(column) * 100) / unit).cast("int")
    start = of("l_discount", 2) * 2
    span = F.struct(start.alias("start"), (start + of("l_tax", 3) + 2).alias("end"))
    lines = t(spark, d, "lineitem").select(F.col("l_partkey").alias("idx"), F.col("l_linenumber").alias("sample"), "l_quantity", (F.col("l_returnflag") == "R").alias("r"), span.alias("span")).repartition("idx")
    return lines.groupBy("idx", "sample").agg((F.sum("l_quantity") > 40).alias("valid"), F.max("r").alias("has"), F.collect_set(F.when(F.col("r"), F.col("span"))).alias("spans"))


def annotations(spark, d) -> tuple[DataFrame, DataFrame]:
    """samples (idx, sample, valid, has) and marks (idx, sample, start, end)."""
    grouped = annotated(spark, d)
    return grouped.select("idx", "sample", "valid", "has"), grouped.select("idx", "sample", F.explode("spans").alias("span")).select("idx", "sample", "span.start", "span.end")


def units() -> Column:
    """Stands for the number of words of a span."""
    return F.floor((F.col("end") - F.col("start")) / 4).cast("int") + 1


_VOTES_SQL = """
lines AS (SELECT l_partkey AS idx, l_linenumber AS sample, l_quantity, l_returnflag = 'R' AS r, CAST(round(l_discount * 100) AS INTEGER) // 2 * 2 AS a, CAST(round(l_tax * 100) AS INTEGER) // 3 AS b FROM lineitem),
grouped AS (SELECT idx, sample, sum(l_quantity) > 40 AS valid, bool_or(r) AS has, coalesce(list_sort(list(DISTINCT a * 1000 + a + b + 2) FILTER (WHERE r)), []) AS codes FROM lines GROUP BY ALL),
marks AS (SELECT idx, sample, valid, CAST(code // 1000 AS INTEGER) AS s, CAST(code % 1000 AS INTEGER) AS e FROM (SELECT idx, sample, valid, unnest(codes) AS code FROM grouped)),
votes AS (SELECT idx, count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE valid AND has) AS has, count(*) FILTER (WHERE valid AND NOT has) AS no FROM grouped GROUP BY idx),
labels_ AS (SELECT idx, s, e, count(DISTINCT sample) AS votes, list_sort(list(DISTINCT sample)) AS samples FROM marks WHERE valid GROUP BY idx, s, e),
kinds AS (SELECT l.*, CASE WHEN votes >= 3 THEN 'exact' WHEN EXISTS (SELECT 1 FROM labels_ x WHERE x.idx = l.idx AND x.votes >= 3 AND greatest(x.s, l.s) < least(x.e, l.e)) THEN 'explained' ELSE 'open' END AS kind FROM labels_ l),
begins AS (SELECT *, CASE WHEN s < coalesce(max(e) OVER (PARTITION BY idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 0 ELSE 1 END AS b FROM kinds WHERE kind = 'open'),
fam AS (SELECT idx, s, e, votes, samples, CAST(sum(b) OVER (PARTITION BY idx ORDER BY s, e) - 1 AS INTEGER) AS family FROM begins),
support AS (SELECT idx, family, count(DISTINCT x) AS support FROM (SELECT idx, family, unnest(samples) AS x FROM fam) GROUP BY ALL),
sizes_ AS (SELECT idx, family, count(*) AS size FROM fam GROUP BY ALL),
pairs AS (SELECT m.idx, m.family, m.s, m.e, m.votes, greatest(0, least(m.e, o.e) - greatest(m.s, o.s)) / (m.e - m.s) AS c FROM fam m JOIN fam o ON m.idx = o.idx AND m.family = o.family AND (m.s <> o.s OR m.e <> o.e)),
members AS (SELECT idx, family, s, e, votes, min(c) AS min_coverage, avg(c) AS avg_coverage, count(*) + 1 AS members, (e - s) // 4 + 1 AS units FROM pairs GROUP BY ALL),
st1 AS (SELECT * FROM members QUALIFY votes = max(votes) OVER (PARTITION BY idx, family)),
st2 AS (SELECT * FROM st1 QUALIFY min_coverage + 1e-12 >= max(min_coverage) OVER (PARTITION BY idx, family)),
st3 AS (SELECT * FROM st2 QUALIFY avg_coverage + 1e-12 >= max(avg_coverage) OVER (PARTITION BY idx, family)),
won AS (SELECT *, min_coverage + 1e-12 >= least(0.85, 0.45 + 0.05 * (units - 1)) AS accepted FROM st3 QUALIFY row_number() OVER (PARTITION BY idx, family ORDER BY units, e - s, s, e) = 1),
outcomes AS (SELECT z.idx, z.family, CASE WHEN support < 3 THEN 'audit_noise' WHEN size < 2 THEN 'hard_match_validation_failed' WHEN accepted THEN 'accepted' ELSE 'family_anchor_overlap_failed' END AS reason, w.s, w.e
  FROM sizes_ z JOIN support p ON z.idx = p.idx AND z.family = p.family LEFT JOIN won w ON z.idx = w.idx AND z.family = w.family),
won_all AS (SELECT idx, s, e FROM kinds WHERE kind = 'exact' UNION ALL SELECT idx, s, e FROM outcomes WHERE reason = 'accepted'),
clash AS (SELECT DISTINCT x.idx FROM won_all x JOIN won_all y ON x.idx = y.idx AND (x.s, x.e) < (y.s, y.e) AND greatest(x.s, y.s) < least(x.e, y.e)),
ladder AS (SELECT v.*, coalesce(x.n, 0) AS n, coalesce(m.trouble, []) AS trouble, c.idx IS NOT NULL AS clash FROM votes v LEFT JOIN (SELECT idx, count(*) AS n FROM won_all GROUP BY idx) x USING (idx)
  LEFT JOIN (SELECT idx, list_sort(list(DISTINCT reason)) AS trouble FROM outcomes WHERE reason NOT IN ('accepted', 'audit_noise') GROUP BY idx) m USING (idx) LEFT JOIN clash c USING (idx)),
reasoned AS (SELECT *, CASE WHEN valid < 3 THEN ['insufficient_valid_samples'] WHEN no >= 4 THEN ['high_confidence_no_skill'] WHEN has < 3 THEN ['has_skill_no_consensus'] WHEN len(trouble) > 0 OR clash OR n = 0
  THEN trouble || CASE WHEN clash THEN ['accepted_span_conflict'] ELSE [] END || CASE WHEN n = 0 THEN ['positive_without_stable_span'] ELSE [] END ELSE ['all_span_families_resolved'] END AS reasons FROM ladder),
status_ AS (SELECT idx, valid, has, no, CASE reasons[1] WHEN 'insufficient_valid_samples' THEN 'abstained' WHEN 'high_confidence_no_skill' THEN 'negative' WHEN 'all_span_families_resolved' THEN 'accepted' ELSE 'unsolved' END AS status, reasons[1] AS reason,
  array_to_string(reasons, ',') AS reasons, CASE WHEN reasons[1] = 'all_span_families_resolved' THEN n ELSE 0 END AS n_spans FROM reasoned)
"""


def valid_marks(spark, d) -> DataFrame:
    samples, marks = annotations(spark, d)
    return marks.join(samples.where("valid").select("idx", "sample"), ["idx", "sample"], "left_semi")


@query(f"WITH {_VOTES_SQL} SELECT idx, valid, has, no FROM votes")
def sample_votes(spark, d):
    return consensus.votes(annotations(spark, d)[0])


@query(f"""WITH {_VOTES_SQL} SELECT idx, s AS start, e AS "end", votes, array_to_string(samples, ',') AS samples FROM labels_""")
def span_votes(spark, d):
    out = consensus.label_votes(valid_marks(spark, d))
    return out.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(f"""WITH {_VOTES_SQL} SELECT idx, s AS start, e AS "end", votes, kind FROM kinds""")
def explained_variants(spark, d):
    return consensus.explained(consensus.label_votes(valid_marks(spark, d))).select("idx", "start", "end", "votes", "kind")


@query(f"""WITH {_VOTES_SQL} SELECT idx, s AS start, e AS "end", family, support FROM fam JOIN support USING (idx, family)""")
def span_families(spark, d):
    return consensus.open_families(consensus.explained(consensus.label_votes(valid_marks(spark, d)))).select("idx", "start", "end", "family", "support")


@query(f"""WITH {_VOTES_SQL} SELECT idx, family, s AS start, e AS "end", round(min_coverage, 9) AS min_coverage, round(avg_coverage, 9) AS avg_coverage, CAST(units AS INTEGER) AS units, CAST(accepted AS INTEGER) AS accepted FROM won""")
def family_anchor(spark, d):
    members = consensus.open_families(consensus.explained(consensus.label_votes(valid_marks(spark, d))))
    won = spans.anchors(spans.family_members(members, "idx"), "idx", units())
    rounded = (F.round(c, 9).alias(c) for c in ("min_coverage", "avg_coverage"))
    return won.select("idx", "family", "start", "end", *rounded, "units", F.col("accepted").cast("int").alias("accepted"))


@query(f"""WITH {_VOTES_SQL} SELECT idx, family, s AS start, e AS "end", CAST(row_number() OVER (PARTITION BY idx, family ORDER BY votes DESC, min_coverage DESC, round(avg_coverage, 12) DESC, units, e - s, s, e) AS INTEGER) AS candidate_rank,
CAST(votes = max(votes) OVER (PARTITION BY idx, family) AS INTEGER) AS eligible, round(avg_coverage, 9) AS avg_coverage FROM members""")
def anchor_rankings(spark, d):
    members = consensus.open_families(consensus.explained(consensus.label_votes(valid_marks(spark, d))))
    # sums in another order differ in the last bits, in SQL too
    near = spans.family_members(members, "idx").withColumn("avg_coverage", F.round("avg_coverage", 12))
    ranked = spans.anchor_rankings(near, "idx", units())
    return ranked.select("idx", "family", "start", "end", "candidate_rank", F.col("eligible").cast("int").alias("eligible"), F.round("avg_coverage", 9).alias("avg_coverage"))


def decided(spark, d) -> DataFrame:
    return consensus.decisions(annotated(spark, d), units())


@query(f"WITH {_VOTES_SQL} SELECT idx, valid, has, no, status, reasons, CAST(n_spans AS BIGINT) AS n_spans FROM status_")
def consensus_status(spark, d):
    return decided(spark, d).select("idx", "valid", "has", "no", "status", F.array_join("reasons", ",").alias("reasons"), F.col("n_spans").cast("long").alias("n_spans"))


@query(f"""WITH {_VOTES_SQL}, positive AS (SELECT idx FROM reasoned WHERE valid >= 3 AND no < 4 AND has >= 3)
SELECT idx, s AS start, e AS "end", 'accepted' AS list FROM won_all JOIN status_ USING (idx) WHERE status = 'accepted' UNION ALL SELECT idx, s, e, 'candidate' FROM labels_ JOIN positive USING (idx) WHERE votes >= 3""")
def consensus_spans(spark, d):
    """The accepted spans and the candidate spans of each sentence."""
    rows = decided(spark, d)
    lists = [rows.select("idx", F.explode(column).alias("x")).select("idx", "x.start", "x.end", F.lit(name).alias("list")) for name, column in (("accepted", "spans"), ("candidate", "candidates"))]
    return lists[0].unionByName(lists[1])


@query(f"WITH {_VOTES_SQL} SELECT status, reasons, count(*) AS n, CAST(sum(n_spans) AS BIGINT) AS n_spans FROM status_ GROUP BY ALL")
def consensus_summary(spark, d):
    rows = decided(spark, d).withColumn("reasons", F.array_join("reasons", ","))
    return rows.groupBy("status", "reasons").agg(F.count("*").alias("n"), F.sum("n_spans").cast("long").alias("n_spans"))


@query(f"WITH {_VOTES_SQL} SELECT idx, round(CASE status WHEN 'accepted' THEN has / valid WHEN 'negative' THEN no / valid END, 9) AS existence_score FROM status_")
def existence_score(spark, d):
    return decided(spark, d).select("idx", F.round(consensus.existence_score("status", "valid", "has", "no"), 9).alias("existence_score"))


@query(f"""WITH {_VOTES_SQL}, sets AS (SELECT idx, sample, codes AS spans FROM grouped WHERE valid),
jac AS (SELECT a.idx, round(avg(CASE WHEN len(list_distinct(a.spans || b.spans)) = 0 THEN 1.0 ELSE len(list_intersect(a.spans, b.spans)) / len(list_distinct(a.spans || b.spans)) END), 6) AS j FROM sets a JOIN sets b ON a.idx = b.idx AND a.sample < b.sample GROUP BY a.idx),
ent AS (SELECT l.idx, round(avg(CASE WHEN l.votes >= v.valid THEN 0.0 ELSE -(l.votes / v.valid * log2(l.votes / v.valid) + (1 - l.votes / v.valid) * log2(1 - l.votes / v.valid)) END), 6) AS h FROM labels_ l JOIN votes v USING (idx) GROUP BY l.idx)
SELECT s.idx, any_value(j) AS mean_jaccard, coalesce(any_value(h), 0.0) AS mean_entropy, round(avg(len(spans)), 6) AS mean_count, CAST(min(len(spans)) AS INTEGER) AS min_count, CAST(max(len(spans)) AS INTEGER) AS max_count FROM sets s LEFT JOIN jac USING (idx) LEFT JOIN ent USING (idx) GROUP BY s.idx""")
def uncertainty(spark, d):
    return consensus.disagreement(annotated(spark, d))


# --- retrieval and gates


def vectors(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").where(checks.finite_vector_ok("embedding", 64)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def reliability(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("demo"), ((F.col("label") % 5 + 1) / 5.0).cast("double").alias("reliability"), F.col("label").cast("int").alias("label"))


_RETRIEVAL_SQL = """
pairs AS (SELECT a.vec_id AS target, b.vec_id AS demo, b.label AS label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY similarity DESC, demo) AS INTEGER) AS neighbor_rank FROM pairs QUALIFY neighbor_rank <= 50),
ranked AS (SELECT *, (label % 5 + 1) / 5.0 AS reliability, row_number() OVER (PARTITION BY target ORDER BY (label % 5 + 1) / 5.0 DESC, similarity DESC, demo) AS r FROM near),
judged AS (SELECT target, demo, label, similarity, CAST(r AS INTEGER) AS retrieval_rank, CAST((target + demo) % 5 + 1 AS INTEGER) AS score, CASE WHEN (target + demo) % 7 = 0 THEN 'irrelevant' WHEN label % 2 = 0 THEN 'supporting' ELSE 'contrastive' END AS role FROM ranked WHERE r <= 16),
gated AS (SELECT *, CASE WHEN score > 3 AND role <> 'irrelevant' THEN CAST(count(*) FILTER (WHERE score > 3 AND role <> 'irrelevant') OVER (PARTITION BY target ORDER BY retrieval_rank) AS BIGINT) END AS gate_rank FROM judged)
"""


def found(spark, d) -> DataFrame:
    v = vectors(spark, d)
    return retrieval.neighbours(v, v, complete=True)


def judged(spark, d) -> DataFrame:
    rows = retrieval.reranked(found(spark, d), reliability(spark, d)).where("selected_rank is not null")
    role = F.when((F.col("target") + F.col("demo")) % 7 == 0, "irrelevant").when(F.col("label") % 2 == 0, "supporting").otherwise("contrastive")
    return rows.select("target", "demo", "label", "similarity", F.col("selected_rank").alias("retrieval_rank"), ((F.col("target") + F.col("demo")) % 5 + 1).cast("int").alias("score"), role.alias("role"))


@query(f"WITH {_RETRIEVAL_SQL} SELECT target, demo, round(similarity, 10) AS similarity, neighbor_rank FROM near")
def cosine_topk(spark, d):
    return found(spark, d).withColumn("similarity", F.round("similarity", 10))


@query(f"WITH {_RETRIEVAL_SQL} SELECT target, demo, round(similarity, 10) AS similarity, neighbor_rank, CAST(reliability AS DOUBLE) AS reliability, CASE WHEN r <= 16 THEN CAST(r AS INTEGER) END AS selected_rank FROM ranked")
def cosine_topk_rerank(spark, d):
    return retrieval.reranked(found(spark, d), reliability(spark, d)).drop("label").withColumn("similarity", F.round("similarity", 10))


@query("""WITH pairs AS (SELECT c.label AS "group", c.vec_id AS candidate, o.vec_id AS token, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])) AS distance FROM embeddings c JOIN embeddings o ON c.label = o.label AND o.vec_id % 2 = 1 WHERE c.vec_id % 2 = 0),
best AS (SELECT "group", candidate, token, distance FROM pairs QUALIFY row_number() OVER (PARTITION BY "group", candidate ORDER BY distance, token) = 1)
SELECT "group", candidate, round(distance, 8) AS distance, token, CAST(row_number() OVER (PARTITION BY "group" ORDER BY best.distance, candidate) AS INTEGER) AS rank FROM best QUALIFY rank <= 5""")
def nearest_token_min(spark, d):
    e = t(spark, d, "embeddings").select(F.col("label").alias("group"), "vec_id", F.col("embedding").alias("v"))
    even = F.col("vec_id") % 2 == 0
    return retrieval.nearest_in_group(e.where(even).withColumnRenamed("vec_id", "candidate"), e.where(~even).withColumnRenamed("vec_id", "token")).withColumn("distance", F.round("distance", 8))


@query(f"WITH {_RETRIEVAL_SQL} SELECT target, demo, score, role, retrieval_rank, gate_rank FROM gated")
def gate_select(spark, d):
    return gate.select(judged(spark, d), "target").select("target", "demo", "score", "role", "retrieval_rank", "gate_rank")


@query(f"""WITH {_RETRIEVAL_SQL}, n AS (SELECT target, count(gate_rank) AS n_selected FROM gated GROUP BY target)
SELECT target, n_selected, CASE WHEN n_selected = 0 THEN 'no_helpful_examples' WHEN n_selected < 2 THEN 'insufficient_helpful_examples' ELSE '' END AS reasons, CASE WHEN n_selected < 2 THEN 'needs_review' ELSE 'complete' END AS status FROM n""")
def gate_reasons(spark, d):
    return gate.selection_records(gate.select(judged(spark, d), "target"), "target").select("target", "n_selected", F.array_join("reasons", ",").alias("reasons"), "status")


@query(f"WITH {_RETRIEVAL_SQL} SELECT role, count(*) AS n, count(gate_rank) AS kept, round(count(gate_rank) / count(*), 6) AS kept_rate, round(avg(score), 6) AS mean_score FROM gated GROUP BY role")
def gate_rates(spark, d):
    return gate.retention(gate.select(judged(spark, d), "target"), "role")


@query(f"WITH {_RETRIEVAL_SQL} SELECT CAST(s AS INTEGER) AS score, count(target) AS n FROM range(1, 6) r(s) LEFT JOIN judged ON score = s GROUP BY s")
def score_distribution_dense(spark, d):
    return gate.distribution(judged(spark, d), "score", range(1, 6))


@query(f"""WITH {_RETRIEVAL_SQL}, n AS (SELECT target, count(*) AS n, count(*) FILTER (WHERE label >= 5) AS pos, count(*) FILTER (WHERE label < 5) AS neg, count(gate_rank) AS sel FROM gated GROUP BY target)
SELECT target, array_to_string(list_sort(list_filter([CASE WHEN pos = n THEN 'all_candidates_accepted' END, CASE WHEN neg >= 8 THEN 'eight_or_more_negative' END, CASE WHEN pos > 0 AND neg > 0 THEN 'both_classes' END, CASE WHEN sel = 0 THEN 'selected_none' END, CASE WHEN sel = 1 THEN 'selected_one' END], lambda x: x IS NOT NULL)), ',') AS strata FROM n""")
def strata(spark, d):
    rows = gate.select(judged(spark, d), "target").withColumn("accepted", F.col("label") >= 5)
    return gate.strata(rows, "target", "accepted").select("target", F.array_join("strata", ",").alias("strata"))


# --- logs and outcomes


def log_rows(spark, d) -> DataFrame:
    return t(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") > 50, "complete").otherwise("failed").alias("status"), F.round("value", 6).alias("value"))


_LOG_SQL = "log AS (SELECT user_id, event_type, event_id, CASE WHEN value > 50 THEN 'complete' ELSE 'failed' END AS status, round(value, 6) AS value FROM events)"
KEYS = ["user_id", "event_type"]


@query(f"WITH {_LOG_SQL} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_record(spark, d):
    return results.latest(log_rows(spark, d), KEYS, "event_id")


@query(f"WITH {_LOG_SQL} SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def stream_latest_record(spark, d):
    schema = t(spark, d, "events").schema
    base = shared.fresh_path(spark, "stream")
    last = log.compact(spark, d, schema, f"{base}/out", f"{base}/checkpoint", KEYS, "event_id", pattern="events.parquet")
    return last.select("user_id", "event_type", "event_id", F.when(F.col("value") > 50, "complete").otherwise("failed").alias("status"), F.round("value", 6).alias("value"))


@query(f"WITH {_LOG_SQL} SELECT event_id FROM log JOIN (SELECT user_id, event_type, min(event_id) AS f FROM log WHERE status = 'complete' GROUP BY ALL) USING (user_id, event_type) WHERE event_id > f")
def append_only_violations(spark, d):
    return results.retried_after_complete(log_rows(spark, d), KEYS, "event_id", F.col("status") == "complete").select("event_id")


@query(f"""WITH {_LOG_SQL}, f AS (SELECT user_id, event_type, min(event_id) FILTER (WHERE status = 'complete') AS f FROM log GROUP BY ALL)
SELECT event_id, CASE WHEN event_id > f THEN 'after_complete' WHEN event_id = f THEN 'complete' ELSE 'attempt' END AS event,
CAST(count(*) FILTER (WHERE f IS NULL OR event_id <= f) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) AS attempt FROM log JOIN f USING (user_id, event_type)""")
def stream_log_events(spark, d):
    """The log as keyed state: what each record does to its key."""
    base = shared.fresh_path(spark, "machine")
    found = machine.follow(spark, d, t(spark, d, "events").schema, f"{base}/out", f"{base}/checkpoint", KEYS, "event_id", F.col("value") > 50, F.lit(None), pattern="events.parquet")
    return found.select(F.col("sequence").alias("event_id"), "event", "attempt")


@query(f"WITH {_LOG_SQL} SELECT DISTINCT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM log WHERE status = 'complete' AND event_type = 'purchase' AND user_id IS NOT NULL)")
def pending_work(spark, d):
    work = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).distinct()
    return results.pending(work, log_rows(spark, d).where("event_type = 'purchase'"), ["user_id"], F.col("status") == "complete")


@query(f"WITH {_LOG_SQL} SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS attempt, CASE WHEN row_number() OVER w = 1 THEN 'initial' ELSE 'repair' END AS kind FROM log WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def attempt_numbers(spark, d):
    return results.attempts(log_rows(spark, d), KEYS, "event_id").select("event_id", "attempt", "kind")


@query(f"WITH {_LOG_SQL} SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM log GROUP BY event_type")
def cost_metrics(spark, d):
    return log_rows(spark, d).groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.expr("status = 'failed'")).alias("failed"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("tokens"))


def outcome_rows(spark, d) -> DataFrame:
    """Orders as prompts; those in status F have a prediction, the others a failure or none."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    predictions = o.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderpriority").startswith("1").alias("recovered"))
    failures = o.where("o_orderstatus = 'O' and o_totalprice > 50000").select("o_orderkey", F.when(F.col("o_orderpriority").startswith("5"), "provider_or_runtime").otherwise("validation_exhausted").alias("kind"), (~F.col("o_orderpriority").startswith("5")).alias("eligible"), F.col("o_orderpriority").startswith("2").alias("provisional"))
    return results.outcomes(o, predictions, failures, "o_orderkey")


_OUTCOME_SQL = """
outcomes_ AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 'recovered' WHEN o_orderstatus = 'F' THEN 'exact' WHEN o_orderstatus = 'O' AND o_totalprice > 50000 THEN
  CASE WHEN o_orderpriority LIKE '5%' THEN 'runtime_failed' WHEN o_orderpriority LIKE '2%' THEN 'provisional' ELSE 'validation_failed' END ELSE 'missing' END AS outcome FROM orders)
"""


@query(f"WITH {_OUTCOME_SQL} SELECT o_orderkey, outcome, CASE WHEN outcome IN ('exact', 'recovered') THEN 'target_sentence' WHEN outcome = 'provisional' THEN 'model_sentence' END AS coordinate_space, CAST(outcome IN ('recovered', 'provisional', 'validation_failed') AS INTEGER) AS validation_issue FROM outcomes_")
def outcome_case(spark, d):
    return outcome_rows(spark, d)


@query(f"""WITH {_OUTCOME_SQL} SELECT CAST(count(*) AS BIGINT) AS n_results, count(DISTINCT o_orderkey) AS n_unique, count(*) FILTER (WHERE outcome IN ('runtime_failed', 'missing')) AS n_blocking,
count(DISTINCT o_orderkey) FILTER (WHERE outcome IN ('recovered', 'provisional', 'validation_failed')) AS n_affected, CAST(floor(count(*) * 0.03 + 1e-12) AS BIGINT) AS allowed, CAST(0 AS INTEGER) AS within FROM outcomes_""")
def quota_status(spark, d):
    rows = outcome_rows(spark, d)
    n = t(spark, d, "orders").agg(F.count("*").alias("n"))
    return results.completion(rows.crossJoin(F.broadcast(n)), rows.where("validation_issue = 1"), "o_orderkey", F.col("n"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS f, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS stages, CAST(sum(n) AS BIGINT) AS n_events FROM f GROUP BY user_id""")
def issue_merge(spark, d):
    out = results.merged_issues(t(spark, d, "events"), "user_id", "event_id", "event_type")
    return out.select("user_id", F.array_join("stages", ",").alias("stages"), "n_events")


# --- assembly


def order_lines(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.max("l_linenumber").cast("int").alias("last_line"))


@query("SELECT o_orderkey, o_orderstatus, n_lines, c_mktsegment FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY ALL) USING (o_orderkey) JOIN customer ON o_custkey = c_custkey")
def context_join(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    segments = o.select("o_orderkey", "o_custkey").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return assemble.contexts(o, [order_lines(spark, d), segments], ["o_orderkey"], aligned=["o_custkey"]).select("o_orderkey", "o_orderstatus", "n_lines", "c_mktsegment")


@query("SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY ALL) USING (o_orderkey) WHERE n <> m")
def misaligned_rows(spark, d):
    lines = order_lines(spark, d)
    left = t(spark, d, "orders").select("o_orderkey").join(lines.select("o_orderkey", F.col("n_lines").cast("long").alias("n")), "o_orderkey")
    return assemble.misaligned(left, lines.select("o_orderkey", F.col("last_line").cast("long").alias("n")), ["o_orderkey"], ["n"])


@query(f"""WITH {_OUTCOME_SQL} SELECT c.o_orderkey, CASE WHEN outcome IN ('exact', 'recovered', 'provisional') THEN 'available' ELSE 'unavailable' END AS trf_availability,
CASE WHEN outcome IN ('exact', 'recovered') THEN 'target_sentence' WHEN outcome = 'provisional' THEN 'model_sentence' END AS trf_space FROM orders c LEFT JOIN (SELECT * FROM outcomes_ WHERE outcome <> 'missing') USING (o_orderkey)""")
def expert_outer_join(spark, d):
    return assemble.proposals(t(spark, d, "orders").select("o_orderkey"), outcome_rows(spark, d).where("outcome <> 'missing'"), "o_orderkey", "trf", "outcome")


def extractors(spark, d) -> tuple[DataFrame, DataFrame]:
    """Gold: a document's distinct words of 14 letters or more. Predicted, for labelled documents: those of 13 that begin with a small letter."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    words = lambda p: F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    gold = docs.select("doc_id", words("[A-Za-zÀ-ÿ]{14,}").alias("spans"))
    predicted = docs.join(t(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", words("[a-zà-ÿ]{13,}").alias("spans"))
    return gold, predicted


_EVAL_SQL = """
gold AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{14,}')) AS g FROM documents),
pred AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[a-zà-ÿ]{13,}')) AS p FROM documents JOIN labels USING (doc_id)),
both_ AS (SELECT doc_id, g, coalesce(p, []) AS p, CAST(p IS NOT NULL AS INTEGER) AS covered FROM gold LEFT JOIN pred USING (doc_id)),
per AS (SELECT doc_id, CAST(len(list_intersect(g, p)) AS INTEGER) AS tp, CAST(len(p) - len(list_intersect(g, p)) AS INTEGER) AS fp, CAST(len(g) - len(list_intersect(g, p)) AS INTEGER) AS fn, covered,
  CAST(covered = 1 AND list_sort(g) = list_sort(p) AS INTEGER) AS exact, CAST(len(g) > 0 AS INTEGER) AS gold_has, CAST(len(p) > 0 AS INTEGER) AS pred_has FROM both_)
"""


@query(f"WITH {_EVAL_SQL} SELECT * FROM per")
def eval_per_sentence(spark, d):
    return metrics.per_target(*extractors(spark, d), "doc_id")


@query(f"""WITH {_EVAL_SQL}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(exact) AS e, sum(covered) AS c, count(*) AS n, sum(tp) / (sum(tp) + sum(fp)) AS p, sum(tp) / (sum(tp) + sum(fn)) AS r FROM per)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1, round(e / n, 9) AS exact_rate, round(c / n, 9) AS coverage FROM s""")
def eval_micro_prf(spark, d):
    return metrics.micro(metrics.per_target(*extractors(spark, d), "doc_id"))


@query(f"""WITH {_EVAL_SQL}, s AS (SELECT count(*) FILTER (WHERE gold_has = 1 AND pred_has = 1) AS tp, count(*) FILTER (WHERE gold_has = 0 AND pred_has = 1) AS fp, count(*) FILTER (WHERE gold_has = 1 AND pred_has = 0) AS fn, count(*) FILTER (WHERE gold_has = 0) AS neg FROM per)
SELECT round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round(CASE WHEN neg = 0 THEN 0.0 ELSE fp / neg END, 9) AS negative_fp_rate FROM s""")
def eval_presence(spark, d):
    return metrics.presence(metrics.per_target(*extractors(spark, d), "doc_id"))


@query()
def bootstrap_ci(spark, d):
    a = metrics.per_target(*extractors(spark, d), "doc_id")
    gold, _ = extractors(spark, d)
    b = metrics.per_target(gold, gold, "doc_id")
    named = lambda x, p: x.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("tp", "fp", "fn", "exact")))
    return metrics.paired_bootstrap(named(a, "a").join(named(b, "b"), "doc_id"), "doc_id")


@query(f"WITH {_EVAL_SQL} SELECT doc_id, CASE WHEN covered = 0 THEN 'missing' WHEN list_sort(g) = list_sort(p) THEN 'exact' WHEN (len(g) > 0) = (len(p) > 0) THEN 'presence' ELSE 'none' END AS agreement FROM both_")
def expert_agreement(spark, d):
    gold, predicted = extractors(spark, d)
    both = gold.join(predicted.withColumnRenamed("spans", "other"), "doc_id", "left")
    return both.select("doc_id", assemble.agreement(F.col("spans"), F.col("other")).alias("agreement"))


@query(f"""WITH {_EVAL_SQL} SELECT doc_id, CAST(len(list_intersect(g, p)) AS INTEGER) AS retained, CAST(len(p) - len(list_intersect(g, p)) AS INTEGER) AS promoted, CAST(len(g) - len(list_intersect(g, p)) AS INTEGER) AS removed,
round(CASE WHEN len(list_distinct(g || p)) = 0 THEN 1.0 ELSE len(list_intersect(g, p)) / len(list_distinct(g || p)) END, 10) AS jaccard FROM both_ WHERE covered = 1""")
def set_changes(spark, d):
    gold, predicted = extractors(spark, d)
    both = gold.join(predicted.withColumnRenamed("spans", "other"), "doc_id").select("doc_id", metrics.changes(F.col("spans"), F.col("other")).alias("c"))
    return both.select("doc_id", *(F.size(f"c.{x}").alias(x) for x in ("retained", "promoted", "removed")), "c.jaccard")


@query("""SELECT o_custkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY f) AS INTEGER) AS place FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY ALL)""")
def ordered_distinct(spark, d):
    return assemble.ordered_distinct(t(spark, d, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 8")
def example_cap(spark, d):
    return assemble.first_examples(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""SELECT l_returnflag, count(*) AS n, round(corr(CAST(l_quantity AS DOUBLE), CAST(l_extendedprice AS DOUBLE)), 6) AS r FROM lineitem GROUP BY l_returnflag""")
def pearson_helpfulness(spark, d):
    return metrics.pearson(t(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y")), ["l_returnflag"], "x", "y")


@query("""SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INTEGER) AS place FROM documents
QUALIFY place <= CASE lang WHEN 'en' THEN 11 WHEN 'fr' THEN 4 WHEN 'de' THEN 5 ELSE 0 END""")
def quota_sample(spark, d):
    return metrics.quota_sample(t(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"], {"en": 11, "fr": 4, "de": 5})


@query("SELECT doc_id FROM labels ORDER BY CAST(quality = 0 AS INTEGER) DESC, md5('0:' || doc_id) LIMIT 20")
def hash_sample(spark, d):
    return metrics.priority_sample(t(spark, d, "labels"), "doc_id", F.col("quality") == 0, 20).select("doc_id")


@query()
def seeded_sample(spark, d):
    """Twenty documents for review: those of bad quality first, each class shuffled by the seeded generator."""
    rows = t(spark, d, "labels").select("doc_id", "quality")
    return draws.shuffled_first(rows, "doc_id", F.col("quality") == 0, 20).select("doc_id", "quality", "drawn")


# --- interaction


def states(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("r"), (F.col("vec_id") % 3).cast("int").alias("h"))


def _step(df: DataFrame, n: int) -> DataFrame:
    """Both new states read both old ones."""
    return df.select("id", F.when(F.col("h") > 0, F.greatest(F.col("r") - 1, F.lit(0))).otherwise(F.col("r")).alias("r"), F.when(F.col("r") % 2 == 0, F.lit(0)).otherwise(F.col("h")).alias("h"))


_STATE_SQL = """
s0 AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS r, CAST(vec_id % 3 AS INTEGER) AS h FROM embeddings),
s1 AS (SELECT id, CASE WHEN h > 0 THEN greatest(r - 1, 0) ELSE r END AS r, CASE WHEN r % 2 = 0 THEN 0 ELSE h END AS h, r AS r0, h AS h0 FROM s0),
s2 AS (SELECT id, CASE WHEN r = r0 AND h = h0 THEN r WHEN h > 0 THEN greatest(r - 1, 0) ELSE r END AS r, CASE WHEN r = r0 AND h = h0 THEN h WHEN r % 2 = 0 THEN 0 ELSE h END AS h, r AS r1, h AS h1, r0, h0 FROM s1)
"""


def order_states(spark, d) -> tuple[rounds.State, DataFrame]:
    """Four kinds of supplier are an order's features, its lines the candidates; and lines (target, demo, text)."""
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").cast("long").alias("demo"), (F.col("l_suppkey") % 4).alias("mode"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    lines = rows.repartition("target").groupBy("target", "demo").agg(F.min(F.struct(F.concat(F.lit("mode "), "mode").alias("mode"), "q", "l_returnflag")).alias("x"))
    lines = lines.select("target", "demo", F.col("x.mode").alias("text"), (F.col("x.q") % 5 + 1).alias("score"), F.when(F.col("x.l_returnflag") == "R", "irrelevant").when(F.col("x.l_returnflag") == "A", "supporting").otherwise("contrastive").alias("role"))
    lines = shared.in_buckets(lines, "order-lines", "target")
    features = rounds.first_features(assemble.ordered_distinct(lines, "target", "demo", "text"))
    types = lines.select("target").distinct().withColumn("has_type", F.lit(True))
    return rounds.State(features, types, rounds.first_judgments(lines.withColumn("retrieval_rank", F.col("demo")))), lines.select("target", "demo", "text")


def _proposals(lines: DataFrame) -> Callable[[rounds.State, int], rounds.Proposals]:
    """A feature is kept if a selected line has it; orders without a selected line get one more; lines gain by an active feature, else they lose."""

    def propose(state: rounds.State, n: int) -> rounds.Proposals:
        chosen = rounds.joined(state.judgments.where("gate_rank is not null").select("target", "demo"), lines, ["target", "demo"])
        cited = chosen.groupBy("target", "text").agg(F.sort_array(F.collect_list("demo")).alias("demos"))
        decided = rounds.joined(state.features.select("target", "text"), cited, ["target", "text"], "left")
        decided = decided.withColumn("action", F.when(F.col("demos").isNotNull(), "keep").otherwise("drop")).withColumn("demos", F.coalesce("demos", F.array().cast("array<long>")))
        idle = rounds.joined(state.types, chosen.select("target").distinct(), "target", "left_anti").select("target", F.lit("OTHER").alias("text"), F.lit(1).alias("position"), F.array().cast("array<long>").alias("demos"))
        added = idle if n == 1 else idle.where("false")
        typed = decided.where("action = 'keep'").select("target").union(added.select("target")).distinct().withColumn("has_type", F.lit(True))
        types = rounds.joined(state.types.select("target"), typed, "target", "left").fillna(False, ["has_type"])
        on = state.features.where("active").select("target", "text", F.lit(1).alias("on"))
        near = rounds.joined(rounds.joined(state.judgments, lines, ["target", "demo"]), on, ["target", "text"], "left")
        score = F.greatest(F.lit(1), F.least(F.lit(5), F.when(F.col("on") == 1, F.col("score") + 1).otherwise(F.col("score") - 1)))
        judged = near.select("target", "demo", score.alias("score"), "role", F.array("text").alias("supports"))
        return rounds.Proposals(decided, added, types, judged)

    return propose


_ROUNDS_SQL = """
lines AS (SELECT l_orderkey AS target, l_linenumber AS demo, min(('mode ' || (l_suppkey % 4), CAST(l_quantity AS INTEGER), l_returnflag)) AS x FROM lineitem GROUP BY ALL),
j0 AS (SELECT target, demo, x[1] AS text, x[2] % 5 + 1 AS score, CASE x[3] WHEN 'R' THEN 'irrelevant' WHEN 'A' THEN 'supporting' ELSE 'contrastive' END AS role FROM lines),
f0 AS (SELECT DISTINCT target, text, true AS active FROM j0),
idle AS (SELECT target FROM j0 GROUP BY target HAVING NOT bool_or(score > 3 AND role <> 'irrelevant')),
j1 AS (SELECT j.target, j.demo, j.text, greatest(1, least(5, j.score + CASE WHEN f.active THEN 1 ELSE -1 END)) AS score, j.role FROM j0 j JOIN f0 f USING (target, text)),
f1 AS (SELECT f.target, f.text, bool_or(coalesce(j.score > 3 AND j.role <> 'irrelevant', false)) AS active FROM f0 f LEFT JOIN j0 j USING (target, text) GROUP BY ALL UNION ALL SELECT target, 'OTHER', true FROM idle),
j2 AS (SELECT j.target, j.demo, j.text, greatest(1, least(5, j.score + CASE WHEN f.active THEN 1 ELSE -1 END)) AS score, j.role FROM j1 j JOIN f1 f USING (target, text)),
f2 AS (SELECT f.target, f.text, bool_or(coalesce(j.score > 3 AND j.role <> 'irrelevant', false)) AS active FROM f1 f LEFT JOIN j1 j USING (target, text) GROUP BY ALL),
moves AS (SELECT a.target, a.text, CASE WHEN b.text IS NULL THEN NULL WHEN b.active THEN 'keep' ELSE 'drop' END AS "from", CASE WHEN a.active THEN 'keep' ELSE 'drop' END AS "to", 1 AS round FROM f1 a LEFT JOIN f0 b USING (target, text) WHERE b.text IS NULL OR a.active <> b.active
  UNION ALL SELECT a.target, a.text, CASE WHEN b.active THEN 'keep' ELSE 'drop' END, CASE WHEN a.active THEN 'keep' ELSE 'drop' END, 2 FROM f2 a JOIN f1 b USING (target, text) WHERE a.active <> b.active)
"""


def _iterated(spark, d) -> rounds.Outcome:
    first, lines = order_states(spark, d)
    return rounds.iterate(first, _proposals(lines))


@query(f"""WITH {_ROUNDS_SQL}, f AS (SELECT target, count(*) AS known, count(*) FILTER (WHERE active) AS active FROM f2 GROUP BY target),
j AS (SELECT target, sum(score) AS score, count(*) FILTER (WHERE score > 3 AND role <> 'irrelevant') AS selected FROM j2 GROUP BY target)
SELECT target, known, active, CAST(score AS BIGINT) AS score, selected FROM f JOIN j USING (target)""")
def round_state(spark, d):
    """Two rounds in which features and judged candidates read each other."""
    s = _iterated(spark, d).state
    f = s.features.groupBy("target").agg(F.count("*").alias("known"), F.count_if("active").alias("active"))
    return rounds.joined(f, s.judgments.groupBy("target").agg(F.sum("score").alias("score"), F.count("gate_rank").alias("selected")), "target")


@query(f"""WITH {_ROUNDS_SQL} SELECT target, text, "from", "to", round FROM moves""")
def round_transitions(spark, d):
    return _iterated(spark, d).transitions


@query(f"""WITH {_ROUNDS_SQL}, chosen AS (SELECT target, demo, text FROM j2 WHERE score > 3 AND role <> 'irrelevant')
SELECT c.target, 'selected_demo_supports_dropped_trf' AS type, c.text, CAST(c.demo AS BIGINT) AS demo FROM chosen c JOIN f2 USING (target, text) WHERE NOT active
UNION ALL SELECT e.target, 'trf_evidence_demo_not_retained', e.text, CAST(e.demo AS BIGINT) FROM j1 e JOIN f2 f ON e.target = f.target AND e.text = f.text AND f.active AND e.score > 3 AND e.role <> 'irrelevant'
  LEFT JOIN chosen c ON c.target = e.target AND c.demo = e.demo WHERE c.demo IS NULL""")
def round_conflicts(spark, d):
    return rounds.conflicts(_iterated(spark, d).state)


@query(f"""WITH {_STATE_SQL} SELECT id, r, h, CASE WHEN r1 = r0 AND h1 = h0 THEN 0 WHEN r = r1 AND h = h1 THEN 1 ELSE 2 END AS round, CAST(r <> r1 OR h <> h1 AS INTEGER) AS changed FROM s2""")
def state_fold(spark, d):
    out = interaction.fold(states(spark, d), _step, ["r", "h"], ["id"])
    return out.select("id", "r", "h", "round", F.col("changed").cast("int").alias("changed"))


@query("""WITH h AS (SELECT user_id, event_id AS round, event_type AS sign FROM events), l AS (SELECT *, lag(sign, 1) OVER w AS a, lag(sign, 2) OVER w AS b FROM h WINDOW w AS (PARTITION BY user_id ORDER BY round))
SELECT DISTINCT user_id FROM l WHERE sign = b AND sign <> a""")
def oscillation(spark, d):
    return interaction.oscillation(t(spark, d, "events").select("user_id", F.col("event_id").alias("round"), F.col("event_type").alias("sign")), ["user_id"])


@query(f"WITH {_RETRIEVAL_SQL} SELECT target, demo FROM judged WHERE (target + demo) % 3 = 0 AND NOT (score > 3 AND role <> 'irrelevant')")
def conflicts_unselected(spark, d):
    rows = gate.select(judged(spark, d), "target")
    evidence = rows.select("target", "demo", ((F.col("target") + F.col("demo")) % 3 == 0).alias("active"))
    return interaction.unselected_evidence(evidence, rows.where("gate_rank is not null"), "target", "demo").select("target", "demo")


@query(f"WITH {_RETRIEVAL_SQL} SELECT target, demo FROM judged WHERE (target + demo) % 3 = 0 AND role = 'irrelevant'")
def conflicts_irrelevant(spark, d):
    rows = judged(spark, d)
    return interaction.irrelevant_evidence(rows.where((F.col("target") + F.col("demo")) % 3 == 0).select("target", "demo"), rows, "target", "demo")


@query(f"""WITH {_RETRIEVAL_SQL}, c AS (SELECT target, demo, score, similarity, CAST((demo * 3 + target) % 5 + 1 AS INTEGER) AS previous, label >= 5 AS accepted, role = 'contrastive' AS contrastive, demo % 11 = 0 AS supported FROM judged),
f AS (SELECT *, supported OR similarity >= 0.58 AS strong FROM c),
g AS (SELECT *, CASE WHEN accepted AND strong THEN greatest(score, 4) WHEN accepted AND previous = 4 AND score >= 4 THEN 3 WHEN accepted THEN score WHEN previous >= 4 AND contrastive AND similarity >= 0.55 THEN greatest(score, previous, 4) WHEN previous >= 4 THEN least(score, 3) ELSE score END AS final FROM f)
SELECT target, demo, CAST(final AS INTEGER) AS score, CASE WHEN accepted AND strong THEN 'supporting' WHEN NOT accepted AND contrastive AND (previous < 4 OR similarity >= 0.55) THEN 'contrastive' WHEN accepted AND final >= 4 THEN 'supporting' ELSE 'irrelevant' END AS role,
CASE WHEN final > previous THEN 'boost' WHEN final < previous THEN 'penalize' ELSE 'none' END AS effect FROM g""")
def score_calibration(spark, d):
    rows = judged(spark, d).withColumn("previous", ((F.col("demo") * 3 + F.col("target")) % 5 + 1).cast("int"))
    c = interaction.calibrated_score(F.col("score"), F.col("previous"), F.col("similarity"), F.col("demo") % 11 == 0, F.col("label") >= 5, F.col("role") == "contrastive")
    return rows.select("target", "demo", c.alias("c")).select("target", "demo", "c.*")


@query()
def judgment_calibration(spark, d):
    """The whole ladder over judged demos, with relations, codes and spans made from their numbers; tests hold it against brute force."""
    n, pick = F.col("demo") * 7 + F.col("target"), lambda k, *some: F.filter(F.array(*map(F.lit, some)), lambda _, i: F.call_function("shiftright", F.col("n"), i + F.lit(k)) % 2 == 1)
    rows = judged(spark, d).withColumn("n", (n * 40503 % 65536).cast("int"))
    rows = rows.select(
        "target", "demo", F.when(F.col("label") >= 5, "accepted").otherwise("negative").alias("status"), "score", F.col("role"), (F.col("n") % 5 + 1).alias("previous"),
        F.when(F.col("n") % 3 == 0, "contrastive").otherwise("irrelevant").alias("previous_role"), pick(0, "NEGATIVE_CONTRAST", "TASK_MISMATCH").alias("previous_codes"), "similarity",
        F.transform(pick(2, "alpha", "beta"), lambda x: F.struct(x.alias("text"), F.when(F.col("n") % 2 == 0, "supports").otherwise("contrasts").alias("relation"))).alias("relations"),
        F.concat(F.array(F.lit("SEMANTIC_ONLY")), pick(4, "TRF_ALIGNED", "BOUNDARY_TRANSFERABLE", "NEGATIVE_CONTRAST", "REDUNDANT")).alias("codes"),
        F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")).alias("active"), pick(8, "Alpha work", "beta").alias("spans"), F.concat_ws(" ", F.lit("we need"), pick(10, "beta", "gamma")).alias("sentence"),
    )
    return interaction.calibrated_judgments(rows).select("target", "demo", "score", "role", "effect", "adjustment", F.array_join("codes", ",").alias("codes"), F.array_join("actions", ",").alias("actions"), F.size("relations").alias("n_relations"))


@query(r"""SELECT item_id, CASE WHEN regexp_matches(text, '(?i)(^|[^\w])the($|[^\w])') THEN 'keep' ELSE 'drop' END AS cue, CASE WHEN regexp_matches(text, '(?i)(^|[^\w])only($|[^\w])') THEN 'drop' ELSE 'keep' END AS adverb FROM benchmark""")
def feature_calibration(spark, d):
    b = t(spark, d, "benchmark")
    return b.select("item_id", interaction.calibrated_feature(F.lit("the"), F.col("text"), F.lit("drop"), ["the"]).alias("cue"), interaction.calibrated_feature(F.lit("only"), F.col("text"), F.lit("keep"), ["the"]).alias("adverb"))


@query(f"""WITH {_RETRIEVAL_SQL} SELECT target, CAST(bool_or(gate_rank IS NOT NULL) AS INTEGER) AS has_kept, CAST(bool_and(score BETWEEN 1 AND 5) AS INTEGER) AS scores_ok,
CASE WHEN count(*) FILTER (WHERE role = 'irrelevant') > 2 THEN 'conflicted' WHEN count(gate_rank) < 2 THEN 'mixed' ELSE 'aligned' END AS status FROM gated GROUP BY target""")
def gate_anchor_checks(spark, d):
    g = gate.select(judged(spark, d), "target")
    a = g.groupBy("target").agg(F.bool_or(F.col("gate_rank").isNotNull()).cast("int").alias("has_kept"), F.bool_and(F.col("score").between(1, 5)).cast("int").alias("scores_ok"), (F.count_if(F.expr("role = 'irrelevant'")) - 2).alias("c"), (2 - F.count("gate_rank")).alias("m"))
    return a.select("target", "has_kept", "scores_ok", interaction.context_status(F.col("c"), F.col("m")).alias("status"))


# --- sources and model answers


@query("SELECT user_id AS idx, 'idx_not_unique' AS rule FROM events GROUP BY user_id HAVING count(*) > 1 UNION ALL SELECT user_id, 'reserved_tag' FROM events WHERE contains(event_type, 'click')")
def source_violations(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("idx"), F.col("event_type").alias("sentence"))
    return relations.sentence_violations(rows, reserved=("click",))


@query("SELECT doc_id AS idx FROM documents WHERE text <> replace(text, '|', '')")
def misplaced_sentences(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("sentence"))
    return relations.misplaced(rows, rows.withColumn("sentence", F.replace("sentence", F.lit("|"), F.lit(""))))


@query("""SELECT item_id AS idx, CAST(strpos(text, ' ') - 1 AS INTEGER) AS start, CAST(strpos(text, ' ') - 1 + length(text) - length(replace(text, ' ', '')) AS INTEGER) AS spaces_after FROM benchmark""")
def substring_counts(spark, d):
    b = t(spark, d, "benchmark")
    first = F.position(F.lit(" "), F.col("text")) - 1
    return b.select(F.col("item_id").alias("idx"), first.cast("int").alias("start"), (first + relations.occurrences(F.col("text"), F.lit(" "))).cast("int").alias("spaces_after"))


# --- relations: what must hold of them


@query("""SELECT DISTINCT doc_id AS idx, 'idx_sets_differ' AS rule FROM labels WHERE doc_id % 50 = 0 OR doc_id % 45 = 0
UNION ALL SELECT doc_id, 'feature_count' FROM labels WHERE doc_id % 45 <> 0 AND (quality = 1 AND doc_id % 40 = 0 OR quality = 0 AND doc_id % 30 = 0)
UNION ALL SELECT doc_id, 'idx_sets_differ' FROM labels WHERE doc_id % 50 = 0 AND doc_id % 45 = 0""")
def bundle_violations(spark, d):
    """Labels as decisions; the corpus lacks every 50th of them, the features every 45th, and some have a feature too few or too many."""
    decisions = t(spark, d, "labels").select(F.col("doc_id").alias("idx"), F.when(F.col("quality") == 1, "accepted").otherwise("negative").alias("status"))
    n = F.when(F.col("status") == "accepted", 5 - (F.col("idx") % 40 == 0).cast("int")).otherwise((F.col("idx") % 30 == 0).cast("int"))
    features = decisions.where("idx % 45 <> 0").select("idx", F.array_repeat(F.lit("f"), n).alias("trfs"))
    return relations.bundle_violations(decisions.where("idx % 50 <> 0").select("idx"), decisions, features)


@query("""WITH rows_ AS (SELECT l_orderkey AS target, l_orderkey + l_partkey % 10 - 5 AS demo, l_linenumber AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem),
n AS (SELECT target, count(*) AS n, count(DISTINCT demo) AS d, bool_or(demo = target) AS own, bool_or(rank <> place) AS moved FROM rows_ GROUP BY target)
SELECT target, unnest(list_filter([CASE WHEN n <> 4 THEN 'count' END, CASE WHEN n <> d THEN 'repeated_demo' END, CASE WHEN own THEN 'self_match' END, CASE WHEN moved THEN 'rank_not_position' END], lambda x: x IS NOT NULL)) AS rule FROM n""")
def candidate_violations(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), (F.col("l_orderkey") + F.col("l_partkey") % 10 - 5).alias("demo"), F.col("l_linenumber").alias("selected_rank"))
    return relations.candidate_violations(rows, 4)


@query("""SELECT vec_id AS idx, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings
WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0 AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0""")
def embedding_cache(spark, d):
    """A log in which every third vector is written again for another sentence, and every fifth by another model."""
    rows = t(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("vec_id").cast("string").alias("sentence"), F.col("embedding").alias("vector"))
    own, other = F.sha2("sentence", 256), F.sha2(F.concat("sentence", F.lit("!")), 256)
    write = lambda seq, sha, name: rows.select("idx", F.lit(seq).alias("seq"), sha.alias("sentence_sha256"), F.lit(name).alias("model"), "vector")
    cache = write(1, own, "m").unionByName(write(2, other, "m").where("idx % 3 = 0")).unionByName(write(3, own, "another").where("idx % 5 = 0"))
    return relations.embedding_cache(cache, rows, "m", 64).select("idx", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


_GOLD_SQL = """
gold AS (SELECT item_id AS idx, text AS sentence, regexp_extract_all(text, '[A-Za-z]{9,}') AS spans, item_id % 7 > 0 AS has FROM benchmark),
each AS (SELECT idx, sentence, unnest(spans) AS s FROM gold)
"""


def gold(spark, d) -> DataFrame:
    """Words of nine letters or more as gold spans, some of which occur more than once."""
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{9,}"), F.lit(0))
    return t(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("sentence"), (F.col("item_id") % 7 > 0).cast("int").alias("has_skill"), words.alias("spans"))


@query(f"""WITH {_GOLD_SQL} SELECT DISTINCT idx, 'span_not_unique' AS rule FROM each WHERE length(sentence) - length(replace(sentence, s, '')) <> length(s)
UNION ALL SELECT idx, 'has_skill_differs' FROM gold WHERE has <> (len(spans) > 0)""")
def gold_violations(spark, d):
    return relations.gold_violations(gold(spark, d))


@query(f"""WITH {_GOLD_SQL} SELECT idx, CAST(strpos(sentence, s) - 1 AS INTEGER) AS start, CAST(strpos(sentence, s) - 1 + length(s) AS INTEGER) AS "end", s AS text FROM each""")
def gold_spans(spark, d):
    return exploded(relations.gold_spans(gold(spark, d)), F.col("spans"), "span", "idx").select("idx", "span.start", "span.end", "span.text")


# --- values by key and by position


@query("""WITH classes AS (SELECT lower(trim(source)) AS phrase, min(doc_id) AS class_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
SELECT doc_id, class_id FROM documents LEFT JOIN classes ON lower(trim(source)) = phrase""")
def class_lookup(spark, d):
    """Sources as phrases, of which some have a class; the rows spell them in another case."""
    docs = t(spark, d, "documents").select("doc_id", "source")
    classes = docs.join(t(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id").groupBy(F.lower(F.trim("source")).alias("phrase")).agg(F.min("doc_id").alias("class_id"))
    return assemble.labelled(docs.select("doc_id", F.concat(F.lit(" "), F.upper("source")).alias("text")), "text", classes).select("doc_id", "class_id")


@query("SELECT doc_id, sha256(replace(replace(text, 'the', '<redacted>'), 'qu', '<redacted>')) AS redacted_sha256 FROM documents")
def redacted_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(T.redacted(F.col("text"), ["the", "qu"]), 256).alias("redacted_sha256"))


@query("""SELECT o_orderkey, 'changed' AS kind, 'o_totalprice' AS "column", CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderkey % 997 = 1
UNION ALL SELECT o_orderkey, 'changed', 'o_orderstatus', 1 FROM orders WHERE o_orderkey % 997 = 1 AND o_orderstatus <> 'X'
UNION ALL SELECT o_orderkey, 'missing', NULL, 1 FROM orders WHERE o_orderkey % 997 = 2 UNION ALL SELECT o_orderkey, 'extra', NULL, 1 FROM orders WHERE o_orderkey % 997 = 3""")
def forged_cells(spark, d):
    """Orders against a copy with changed, missing and repeated rows: each is located."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    place = F.col("o_orderkey") % 997
    copy = orders.where(place != 2).withColumns({"o_totalprice": F.when(place == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(place == 1, "X").otherwise(F.col("o_orderstatus"))})
    copy = copy.unionByName(copy.where(place == 3))
    return hashtree.located(orders, copy, ["o_orderkey"]).select("o_orderkey", "kind", "column", "n")


@query("""SELECT event_id, array_to_string([CASE i - event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '-' END FOR i IN [4, 2, 6]], ',') AS names FROM events""")
def reordered_items(spark, d):
    at = lambda k, name: F.struct((F.col("event_id") % 5 + k).alias("id"), name.alias("name"))
    rows = t(spark, d, "events").select("event_id", F.array(at(0, F.col("event_type")), at(1, F.lit("b")), at(2, F.lit("c"))).alias("items"))
    found = assemble.reordered(F.col("items"), F.array(*(F.lit(i).cast("long") for i in (4, 2, 6))), "id")
    return rows.select("event_id", F.array_join(F.transform(found, lambda x: F.coalesce(x["name"], F.lit("-"))), ",").alias("names"))


_FROZEN_PARTS = ", ".join(f"sum(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT)) AS s{k}" for k in range(8))


@query(f"""WITH hashed AS (SELECT sha256(CAST(to_json(struct_pack(idx := item_id, sentence := text)) AS VARCHAR)) AS h FROM benchmark), sums AS (SELECT count(*) AS n, {_FROZEN_PARTS} FROM hashed),
mark AS (SELECT sha256('{{"n":' || n || {" || ".join(f"""',"s{k}":' || s{k}""" for k in range(8))} || '}}') AS source_sha256 FROM sums)
SELECT 'sentence-dataset-' || left(source_sha256, 16) AS dataset_id, 'sentence-' || item_id AS record_id, source_sha256, item_id AS idx FROM benchmark, mark""")
def frozen_targets(spark, d):
    rows = relations.independent_targets(t(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("sentence")))
    return rows.select("dataset_id", "record_id", "source_sha256", "idx")


_STRICT_SQL = r"""
kinds AS (SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 10 AS kind, regexp_extract(coalesce(text, ''), '^[A-Za-z]+') AS word FROM conversations)
"""


@query(rf"""WITH {_STRICT_SQL} SELECT id, CASE WHEN kind = 0 AND word <> '' THEN '[[0, ' || length(word) || ', "' || word || '"]]' WHEN kind = 9 THEN '[]' END AS value,
CASE WHEN kind = 0 AND word <> '' OR kind = 9 THEN NULL WHEN kind IN (0, 2) THEN 'nested, unclosed or empty tag' WHEN kind = 1 THEN 'not JSON' WHEN kind = 3 THEN 'the text differs from its source'
WHEN kind = 4 THEN 'unmatched closing tag' WHEN kind = 5 THEN 'keys must be [''annotated_sentence'']' WHEN kind = 6 THEN 'repeated key' WHEN kind = 7 THEN 'NaN isn''t JSON' ELSE 'annotated_sentence must be a string' END AS error FROM kinds""")
def strict_parse(spark, d):
    """Every answer with its spans or its error; tagged texts, and each kind of error."""
    said = F.coalesce("text", F.lit(""))
    rows = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), said.alias("sentence"), ((F.col("conv_id") + F.col("turn")) % 10).alias("kind"), F.regexp_extract(said, "^[A-Za-z]+", 0).alias("word"))
    kind, sentence, word = F.col("kind"), F.col("sentence"), F.col("word")
    rest = F.expr("substring(sentence, length(word) + 1)")
    told = (
        F.when(kind == 0, F.concat(F.lit("<skill>"), word, F.lit("</skill>"), rest)).when(kind == 2, F.concat(F.lit("<skill>a<skill>b</skill>"), sentence))
        .when(kind == 3, F.concat(sentence, F.lit("!"))).when(kind == 4, F.concat(F.lit("a</skill>"), sentence)).otherwise(sentence)
    )
    content = F.to_json(F.struct(told.alias("annotated_sentence")))
    content = (
        F.when(kind == 1, F.concat(content, F.lit(" and more"))).when(kind == 5, F.lit('{"other": ""}')).when(kind == 6, F.lit('{"annotated_sentence": "a", "annotated_sentence": "b"}'))
        .when(kind == 7, F.lit('{"annotated_sentence": NaN}')).when(kind == 8, F.lit('{"annotated_sentence": 1}')).otherwise(content)
    )
    parsed = protocol.parsed(rows.withColumn("content", content), protocol.tagged_spans, "sentence")
    return parsed.select("id", "value", F.when(F.col("error").startswith("not JSON"), "not JSON").otherwise(F.col("error")).alias("error"))


@query(r"""WITH escaped AS (SELECT item_id, list_aggregate(list_transform(str_split(CAST(to_json(text) AS VARCHAR), ''), lambda c: CASE WHEN unicode(c) > 127 THEN format('\u{:04x}', unicode(c)) ELSE c END), 'string_agg', '') AS quoted FROM benchmark)
SELECT item_id AS id, 'complete' AS status, CAST(2 AS INTEGER) AS n_attempts, '{"digest": "' || left(sha256('[{"role": "user", "content": ' || quoted || '}, {"role": "assistant", "content": "not json"}, '
  || '{"role": "user", "content": "Repair: not JSON: Expecting value: line 1 column 1 (char 0)"}]'), 8) || '"}' AS content FROM escaped""")
def model_conversation(spark, d):
    prompts = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return model.converse(prompts, lambda: model.FakeClient(fail_first=1), _json_error).select("id", "status", "n_attempts", "content")


@query("""SELECT item_id AS id, ['request', 'parse', 'final state', 'attempts', 'no answer'][item_id % 6] AS reason FROM benchmark WHERE item_id % 6 > 0""")
def attempt_replay(spark, d):
    """Attempt chains replayed: some untouched, others with a forged request, error or final state, a missing attempt, or no row at all."""
    prompts = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    kind = F.col("id") % 6
    raw = model.converse(prompts, lambda: model.FakeClient(fail_first=1), _json_error).where(kind != 5)
    forged = {
        "request_sha256": F.when(kind == 1, F.array(F.get("request_sha256", 0), F.lit("0" * 64))).otherwise(F.col("request_sha256")),
        "errors": F.when(kind == 2, F.array(F.lit("another error"), F.lit(None))).otherwise(F.col("errors")),
        "status": F.when(kind == 3, "failed").otherwise(F.col("status")),
        "n_attempts": F.when(kind == 4, F.lit(1)).otherwise(F.col("n_attempts")),
    }
    return model.replay_errors(raw.withColumns(forged), prompts, _json_error)


def _json_error(content: str) -> str | None:
    try:
        protocol.strict_object(content, {"digest"})
    except protocol.Invalid as e:
        return str(e)
    return None


# --- diagnostics


@query(f"WITH {_RETRIEVAL_SQL}, n AS (SELECT target, count(gate_rank) AS s FROM gated GROUP BY target) SELECT CASE WHEN s = 0 THEN 'no_helpful_examples' ELSE 'insufficient_helpful_examples' END AS reason, count(*) AS n FROM n WHERE s < 2 GROUP BY 1")
def reason_counts(spark, d):
    return diagnostics.exploded_counts(gate.selection_records(gate.select(judged(spark, d), "target"), "target"), "reasons", "reason")


@query(f"WITH {_LOG_SQL}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) SELECT status, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS event_id FROM last GROUP BY status")
def call_summary(spark, d):
    return diagnostics.call_summary(results.latest(log_rows(spark, d), KEYS, "event_id"), "status", ["event_id"])


@query("""WITH f AS (SELECT item_id, unnest(range(5)) AS s FROM benchmark), r AS (SELECT item_id, count(*) FILTER (WHERE (item_id * 7 + s * 3) % 4 > 0) AS n_ok FROM f GROUP BY item_id)
SELECT item_id, n_ok, CASE WHEN n_ok = 5 THEN 'complete' WHEN n_ok > 0 THEN 'partial_failed' ELSE 'failed' END AS status FROM r""")
def sample_fan_out(spark, d):
    calls = diagnostics.fan_out(t(spark, d, "benchmark").select("item_id"))
    return diagnostics.rolled_up(calls, "item_id", (F.col("item_id") * 7 + F.col("sample_index") * 3) % 4 > 0)


@query(f"""WITH {_OUTCOME_SQL}, a AS (SELECT o_orderkey, outcome, n FROM outcomes_ JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (o_orderkey))
SELECT count(*) AS n, round(count(*) FILTER (WHERE outcome IN ('exact', 'recovered')) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS repair_rate,
round(count(*) FILTER (WHERE outcome IN ('runtime_failed', 'missing')) / count(*), 6) AS failure_rate, round(count(*) FILTER (WHERE outcome IN ('recovered', 'provisional', 'validation_failed')) / count(*), 6) AS issue_rate,
round(count(*) FILTER (WHERE outcome = 'provisional') / count(*), 6) AS provisional_rate FROM a""")
def operational_rates(spark, d):
    rows = outcome_rows(spark, d).join(order_lines(spark, d).select("o_orderkey", F.col("n_lines").alias("n_attempts")), "o_orderkey")
    return diagnostics.operational_rates(rows)


def run_targets(spark, d) -> DataFrame:
    """Orders as targets of a run: with a prediction, a last call and two experts each, the lines their examples."""
    k = F.col("o_orderkey")
    rows = outcome_rows(spark, d).join(order_lines(spark, d).select("o_orderkey", (F.col("n_lines") - 1).alias("n_examples")), "o_orderkey", "left").fillna(0, ["n_examples"])
    good = F.col("outcome").isin("exact", "recovered")

    def expert(m: int) -> Column:
        there = k % m > 0
        has = (k % 5 > 1).cast("int")
        spans = F.array((k % 3).cast("int"))
        return F.when(k % 2 == 0, F.struct(there.alias("available"), F.when(there, has + F.lit(0)).alias("has_skill"), F.when(k % m == 1, F.array(F.lit(9))).otherwise(spans).alias("spans"), F.when(k % m == 2, "model_sentence").otherwise("target_sentence").alias("space"), F.when(k % m == 2, "provisional").otherwise("exact").alias("outcome")))

    return rows.select(
        "o_orderkey", "outcome", F.when(good, F.when(k % 4 == 0, "needs_review").otherwise("complete")).alias("status"), F.when(good, (k % 3 > 0).cast("int")).alias("has_skill"), F.when(good, k % 3).alias("n_spans"),
        F.when(good, "complete").otherwise("failed").alias("raw_status"), (k % 7 == 0).alias("repaired"), (F.col("outcome") == "recovered").alias("recovered"), (k % 3).alias("n_features"), "n_examples",
        expert(6).alias("trf"), expert(8).alias("exemplar"),
    )


@query(f"""WITH {_OUTCOME_SQL}, rows_ AS (SELECT o_orderkey AS k, outcome, outcome IN ('exact', 'recovered') AS good, coalesce(n, 1) - 1 AS ex, k % 2 = 0 AS e FROM outcomes_ LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (o_orderkey))
SELECT figure, CAST(n AS BIGINT) AS n FROM (SELECT count(*) AS targets, count(*) FILTER (WHERE good) AS predictions, count(*) FILTER (WHERE good AND k % 4 > 0) AS complete, count(*) FILTER (WHERE good AND k % 4 = 0) AS needs_review,
  count(*) FILTER (WHERE good AND k % 3 > 0) AS positive, count(*) FILTER (WHERE outcome IN ('validation_failed', 'runtime_failed')) AS failed, count(*) FILTER (WHERE outcome <> 'missing') AS results,
  {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS outcome_{o}" for o in diagnostics.OUTCOMES)}, count(*) FILTER (WHERE outcome IN ('recovered', 'provisional', 'validation_failed')) AS validation_issues,
  count(*) FILTER (WHERE k % 7 = 0) AS repair_attempted, count(*) FILTER (WHERE k % 7 = 0 AND good) AS repaired, count(*) FILTER (WHERE outcome = 'recovered') AS recovered, count(*) FILTER (WHERE k % 3 = 0) AS no_features,
  count(*) FILTER (WHERE ex = 0) AS no_examples, count(*) FILTER (WHERE ex = 1) AS one_example, count(*) FILTER (WHERE e) AS with_experts, count(*) FILTER (WHERE e AND k % 6 > 0 AND k % 8 > 0) AS both_experts,
  count(*) FILTER (WHERE e AND k % 6 = 0) AS trf_missing, count(*) FILTER (WHERE e AND k % 8 = 0) AS exemplar_missing, count(*) FILTER (WHERE e AND k % 6 > 0 AND k % 8 > 0) AS presence_agrees,
  count(*) FILTER (WHERE e AND k % 6 > 0 AND k % 8 > 0 AND k % 6 <> 2 AND k % 8 <> 2 AND (k % 6 = 1) = (k % 8 = 1)) AS spans_agree, count(*) FILTER (WHERE e AND k % 6 = 2) AS trf_provisional, count(*) FILTER (WHERE e AND k % 8 = 2) AS exemplar_provisional,
  CAST(sum(CASE WHEN good THEN k % 3 END) AS BIGINT) AS spans, CAST(sum(ex) AS BIGINT) AS examples FROM rows_) UNPIVOT (n FOR figure IN (COLUMNS(*)))""")
def run_summary(spark, d):
    """All figures of a run in one pass."""
    return diagnostics.run_summary(run_targets(spark, d))


@query("""WITH c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS c FROM labels), p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS n FROM c),
k AS (SELECT doc_id, CASE WHEN c < 2 AND n <= 5 THEN ['toxic', 'bad'][c + 1] ELSE 'fill' END AS category FROM p)
SELECT doc_id, category FROM k ORDER BY category = 'fill', doc_id LIMIT 20""")
def review_sample(spark, d):
    return diagnostics.review_sample(t(spark, d, "labels"), "doc_id", [("toxic", F.col("toxic") == 1), ("bad", F.col("quality") == 0)], 5, 20)


@query("SELECT l_orderkey, CAST(max(l_shipdate) < min(l_shipdate + INTERVAL 60 DAY) AS INTEGER) AS overlap FROM lineitem GROUP BY l_orderkey")
def job_overlaps(spark, d):
    jobs = t(spark, d, "lineitem").select("l_orderkey", "l_shipdate", (F.col("l_shipdate") + F.expr("INTERVAL 60 DAYS")).alias("until"))
    return diagnostics.job_overlaps(jobs, "l_orderkey", "l_shipdate", "until")


@query("""SELECT a.c_custkey, CAST((c_acctbal > 0) = coalesce(b.active, false) AS INTEGER) AS passed FROM customer a
LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) > 300000 AS active FROM orders GROUP BY ALL) b USING (c_custkey)""")
def anchor_checks(spark, d):
    anchors = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, "keep").otherwise("drop").alias("must"))
    state = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_totalprice") > 300000).alias("active"))
    return diagnostics.anchor_checks(anchors, state, ["c_custkey"])


@query(f"""WITH {_EVAL_SQL}, s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(exact) AS e, count(*) AS n FROM per), f AS (SELECT round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1, round(e / n, 9) AS e FROM s),
g AS (SELECT CASE WHEN count(*) FILTER (WHERE gold_has = 0) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE gold_has = 0 AND pred_has = 1) / count(*) FILTER (WHERE gold_has = 0), 9) END AS neg FROM per)
SELECT round(1.0 - f1, 9) AS delta_f1, round(1.0 - e, 9) AS delta_exact, round(0.0 - neg, 9) AS delta_negative, CAST((f1 < 1 AND e <= 1 OR e < 1 AND f1 <= 1) AND neg >= 0 AS INTEGER) AS contributes FROM f, g""")
def run_comparison(spark, d):
    gold, predicted = extractors(spark, d)
    return diagnostics.comparison(metrics.per_target(gold, predicted, "doc_id"), metrics.per_target(gold, gold, "doc_id"))


@query(f"""WITH {_EVAL_SQL} SELECT doc_id, round(CASE WHEN len(list_distinct(g || p)) = 0 THEN 1.0 ELSE len(list_intersect(g, p)) / len(list_distinct(g || p)) END, 6) AS jaccard,
CASE WHEN len(g) > 0 THEN round(len(list_intersect(g, p)) / len(g), 6) END AS recall FROM both_ WHERE covered = 1""")
def leave_one_out_agreement(spark, d):
    gold, predicted = extractors(spark, d)
    both = gold.join(predicted.withColumnRenamed("spans", "other"), "doc_id")
    return both.select("doc_id", *diagnostics.leave_one_out_agreement(F.col("other"), F.col("spans")))


@query("""WITH a AS (SELECT o_custkey AS k, o_orderpriority AS v, 0 AS w, min(o_orderkey) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority, 1, min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL),
u AS (SELECT k, v, min(w * 1000000000000 + f) AS f FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k, v)
SELECT k AS o_custkey, v AS o_orderpriority, CAST(row_number() OVER (PARTITION BY k ORDER BY f) AS INTEGER) AS place FROM u""")
def feature_renumber(spark, d):
    o = t(spark, d, "orders")
    return diagnostics.renumbered(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'trf_context_needs_review' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'exemplar_context_needs_review' END,
CASE WHEN count(o_orderkey) = 0 THEN 'no_helpful_examples' END, CASE WHEN count(o_orderkey) = 1 THEN 'insufficient_helpful_examples' END, CASE WHEN max(o_totalprice) IS NULL OR max(o_totalprice) <= 300000 THEN 'expert_prediction_missing:trf' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal, c_mktsegment""")
def aggregator_reasons(spark, d):
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    rows = t(spark, d, "customer").join(o, "c_custkey", "left").fillna(0, ["n", "top"])
    review = lambda c: F.when(c, "needs_review").otherwise("complete")
    why = assemble.review_reasons(review(F.col("c_acctbal") < 0), review(F.col("c_mktsegment") == "BUILDING"), F.col("n"), {"trf": F.when(F.col("top") > 300000, "available").otherwise("unavailable")})
    return rows.select("c_custkey", F.col("n").cast("long").alias("n"), F.array_join(why, ",").alias("reasons"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def identity_selection(spark, d):
    wanted = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return assemble.selected(t(spark, d, "orders").select("o_orderkey", "o_custkey"), wanted, ["o_custkey"])


@query("""WITH w AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + 12 AS e, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS x FROM lineitem)
SELECT a.k, CAST(a.s AS INTEGER) AS start, CAST(a.e AS INTEGER) AS "end", round(avg(b.q), 9) AS v0, round(avg(b.x), 9) AS v1 FROM w a JOIN w b ON a.k = b.k AND greatest(a.s, b.s) < least(a.e, b.e) GROUP BY a.k, a.s, a.e""")
def pooled_vectors(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).cast("int").alias("start"), "l_quantity", "l_discount").withColumn("end", F.col("start") + 12)
    pieces = line.select("k", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("v"))
    return retrieval.pooled(line.select("k", "start", "end"), pieces, "k").select("k", "start", "end", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"))


# --- replay


@query("SELECT user_id, event_type, event_id, CAST('left' AS VARCHAR) AS only_in FROM events WHERE false")
def replay_diff(spark, d):
    rows = log_rows(spark, d)
    again = results.attempts(rows, KEYS, "event_id").groupBy(*KEYS).agg(F.max("event_id").alias("event_id"))
    return checks.difference(results.latest(rows, KEYS, "event_id").select("user_id", "event_type", "event_id"), again)
