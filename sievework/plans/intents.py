"""Intent of order lines ("new bolt 1-URGENT"), re-ranking and ambiguity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intent
from ..operators.queries import detect_ambiguity, refine_query
from ..session import table
from .registry import literal, query, values_sql

CONDITIONS = [
    ("hot bolt", "acute"), ("bolt", "acute"), ("small widget", "routine"), ("widget", "chronic"), ("old", "chronic"),
    ("anvil", "routine"), ("ring", "acute"),
]
FOLLOWED = r"\b(low|cold|known)\b"
RULES = {
    "acute": r"\b(hot|urgent)\b",
    "followed": r"\b(low|known|small)\b",
    "phases": [
        ("initial", [r"\b(new|initial)\b", r"\b(gear|gizmo)\b", r"\?"]),
        ("surveillance", [r"\b(old|routine)\b", r"\b(low|medium)\b", r"\b(rod|ring)\b"]),
        ("treatment", [r"\b(plate|anvil)\b", r"\b(red|blue)\b"]),
    ],
    "urgencies": [
        ("acute", [r"\b(urgent|high)\b", r"\b(hot|new)\b"]), ("chronic", [r"\b(old|medium)\b"]), ("routine", [r"\b(low|small)\b"]),
    ],
}

# the query text of a line; the id is its position in the order
LINES = (
    "l AS (SELECT l_orderkey * 16 + l_linenumber AS qid, min(p_name || ' ' || o_orderpriority) AS text FROM lineitem JOIN part ON "
    "p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"
)


def lines(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return (
        li.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
        .join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("qid"))
        .agg(F.min(F.concat_ws(" ", "p_name", "o_orderpriority")).alias("text"))
    )


def _class_sql(classes):
    """Label and confidence: the first class with the highest pattern count, capped at 0.95."""
    counts = [(n, " + ".join(f"CAST(regexp_matches(q, {literal(p)}) AS INTEGER)" for p in ps)) for n, ps in classes]
    top = "greatest(" + ", ".join(c for _, c in counts) + ")"
    label = f"CASE WHEN {top} = 0 THEN 'unknown' " + " ".join(f"WHEN {c} = {top} THEN '{n}'" for n, c in counts) + " END"
    return label, f"CASE WHEN {top} = 0 THEN 0.5 ELSE least(0.95, 0.6 + {top} * 0.1) END"


def phase_of(rules, part):
    """A part of the rule intent of ``q``: phase, urgency, their confidences or the source."""
    short = f"(regexp_matches(q, {literal(rules['acute'])}) AND NOT regexp_matches(q, {literal(rules['followed'])}))"
    phase, phase_conf = _class_sql(rules["phases"])
    urgency, urgency_conf = _class_sql(rules["urgencies"])
    acute, plain = {
        "phase": ("'initial'", phase), "phase_confidence": ("0.85", phase_conf), "urgency": ("'acute'", urgency), "urgency_confidence": ("0.9", urgency_conf),
        "source": ("'rules-acute-condition'", "'rules'"),
    }[part]
    return f"CASE WHEN {short} THEN {acute} ELSE {plain} END"


RULE_SQL = (
    f"ru AS (SELECT qid, q, {phase_of(RULES, 'phase')} AS phase, {phase_of(RULES, 'urgency')} AS urgency, {phase_of(RULES, 'phase_confidence')} AS pc, "
    f"{phase_of(RULES, 'urgency_confidence')} AS uc, {phase_of(RULES, 'source')} AS source FROM (SELECT qid, lower(text) AS q FROM l))"
)
COND_SQL = (
    values_sql("cond", "seq, name, cu", [(i, n, u) for i, (n, u) in enumerate(CONDITIONS)])
    + f", cd AS (SELECT ru.*, name AS condition, CASE WHEN name IS NULL THEN NULL WHEN regexp_matches(q, {literal(FOLLOWED)}) THEN "
    f"'routine' ELSE cu END AS c_urgency, CASE WHEN name IS NULL THEN NULL WHEN regexp_matches(q, {literal(FOLLOWED)}) THEN 0.75 ELSE "
    "0.85 END AS c_conf FROM ru LEFT JOIN (SELECT qid, arg_min(name, seq) AS name, arg_min(cu, seq) AS cu FROM ru JOIN cond ON "
    "regexp_matches(q, '\\b' || name || '\\b') GROUP BY 1) m USING (qid))"
)


@query(
    "rule_intent",
    sql=f"WITH {LINES}, {RULE_SQL} SELECT qid, phase, urgency, round(pc, 4) AS phase_confidence, round(uc, 4) AS urgency_confidence, "
    "source FROM ru",
)
def rule_intent(spark, sf):
    rows = intent.per_text(lines(spark, sf), intent.rule_intent(F.col("text"), **RULES), "r")
    return rows.select(
        "qid", "r.phase", "r.urgency", F.round("r.phase_confidence", 4).alias("phase_confidence"),
        F.round("r.urgency_confidence", 4).alias("urgency_confidence"), "r.source",
    )


@query(
    "condition_urgency",
    sql=f"WITH {LINES}, {RULE_SQL}, {COND_SQL} SELECT qid, condition, c_urgency AS urgency, c_conf AS confidence FROM cd WHERE condition "
    "IS NOT NULL",
)
def condition_urgency(spark, sf):
    c = intent.condition_urgency(F.col("text"), CONDITIONS, FOLLOWED)
    return lines(spark, sf).select("qid", c.alias("c")).filter("c is not null").select(
        "qid", "c.condition", "c.urgency", "c.confidence"
    )


# model scores of a line: softmax over logits read from its numbers
LOGITS_SQL = (
    "lg AS (SELECT l_orderkey * 16 + l_linenumber AS qid, [max(l_quantity) / 10, max(l_discount) * 50, max(l_tax) * 60, "
    "max(l_linenumber) / 2.0] AS p, [max(l_tax) * 50, max(l_discount) * 40, max(l_quantity) / 12, 1.0] AS u FROM lineitem GROUP BY 1)"
)
PICK_SQL = (
    "pk AS (SELECT qid, ['initial','surveillance','treatment','unknown'][list_position(p, list_max(p))] AS mp, "
    "1 / list_sum(list_transform(p, lambda x: exp(x - list_max(p)))) AS mpc, ['acute','chronic','routine','unknown'][list_position(u, "
    "list_max(u))] AS mu, 1 / list_sum(list_transform(u, lambda x: exp(x - list_max(u)))) AS muc FROM lg)"
)


def logits(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("qid")).agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_linenumber").alias("n")
    )
    return g.select(
        "qid",
        F.array(F.col("q") / 10, F.col("d") * 50, F.col("t") * 60, F.col("n") / F.lit(2.0)).alias("p"),
        F.array(F.col("t") * 50, F.col("d") * 40, F.col("q") / 12, F.lit(1.0)).alias("u"),
    )


def model_scores(spark, sf):
    picked = logits(spark, sf).select(
        "qid",
        intent.softmax_pick(F.col("p"), ["initial", "surveillance", "treatment", "unknown"]).alias("p"),
        intent.softmax_pick(F.col("u"), ["acute", "chronic", "routine", "unknown"]).alias("u"),
    )
    return picked.select(
        "qid", F.col("p.label").alias("phase"), F.col("u.label").alias("urgency"),
        F.col("p.confidence").alias("phase_confidence"), F.col("u.confidence").alias("urgency_confidence"),
    )


@query(
    "softmax_pick",
    sql=f"WITH {LOGITS_SQL}, {PICK_SQL} SELECT qid, mp AS phase, mu AS urgency, round(mpc, 6) AS phase_confidence, round(muc, 6) AS "
    "urgency_confidence FROM pk",
)
def softmax_pick(spark, sf):
    m = model_scores(spark, sf)
    return m.select(
        "qid", "phase", "urgency", F.round("phase_confidence", 6).alias("phase_confidence"),
        F.round("urgency_confidence", 6).alias("urgency_confidence"),
    )


MERGE_SQL = (
    "me AS (SELECT cd.qid, condition, c_urgency, c_conf, CASE WHEN (mp = 'unknown' OR mpc < 0.7) AND phase <> 'unknown' AND pc > 0.6 "
    "THEN phase WHEN mp = 'unknown' OR mpc < 0.7 THEN 'initial' ELSE mp END AS ph, CASE WHEN (mp = 'unknown' OR mpc < 0.7) AND phase "
    "<> 'unknown' AND pc > 0.6 THEN pc WHEN mp = 'unknown' OR mpc < 0.7 THEN 0.6 ELSE mpc END AS phc, CASE WHEN (mp = 'unknown' OR mpc "
    "< 0.7) AND phase <> 'unknown' AND pc > 0.6 THEN 'hybrid' WHEN mp = 'unknown' OR mpc < 0.7 THEN 'default' ELSE 'model' END AS src, "
    "CASE WHEN (mu = 'unknown' OR muc < 0.7) AND urgency <> 'unknown' AND uc > 0.6 THEN urgency ELSE mu END AS ur, CASE WHEN (mu = "
    "'unknown' OR muc < 0.7) AND urgency <> 'unknown' AND uc > 0.6 THEN uc ELSE muc END AS urc FROM cd JOIN pk USING (qid)), "
    "fi AS (SELECT *, condition IS NOT NULL AND (ur = 'unknown' OR urc < 0.7) AS st FROM me), "
    "res AS (SELECT qid, ph AS phase, CASE WHEN st THEN c_urgency ELSE ur END AS urgency, phc AS phase_confidence, CASE WHEN st THEN "
    "c_conf ELSE urc END AS urgency_confidence, CASE WHEN st THEN src || '+condition-default' ELSE src END AS source, condition FROM fi)"
)
MERGED = f"WITH {LINES}, {RULE_SQL}, {COND_SQL}, {LOGITS_SQL}, {PICK_SQL}, {MERGE_SQL}"


def classified(spark, sf):
    return intent.classify_intent(lines(spark, sf), model_scores(spark, sf), RULES, CONDITIONS, FOLLOWED)


@query(
    "classified_intent",
    sql=MERGED + " SELECT qid, phase, urgency, round(phase_confidence, 6) AS phase_confidence, round(urgency_confidence, 6) AS "
    "urgency_confidence, source, condition FROM res",
)
def classified_intent(spark, sf):
    c = classified(spark, sf)
    return c.withColumns(
        {n: F.round(n, 6) for n in ("phase_confidence", "urgency_confidence")}
    )


NAME_PHASES = [("surveillance", ["old", "ring"]), ("treatment", ["plate"]), ("initial", ["new", "gear", "bolt"])]
NAME_URGENCIES = [("acute", ["hot", "urgent"]), ("chronic", ["old"]), ("routine", ["low", "small", "large"])]


def name_sql(x, classes):
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in classes
    ) + " ELSE 'unknown' END"


@query(
    "intent_reranked",
    sql=MERGED + f", it AS (SELECT qid AS id, l_orderkey, text AS name, {name_sql('text', NAME_PHASES)} AS ip, "
    f"{name_sql('text', NAME_URGENCIES)} AS iu, qid % 16 AS ln FROM l JOIN (SELECT DISTINCT l_orderkey, l_orderkey * 16 + l_linenumber "
    "AS qid FROM lineitem) USING (qid)), "
    "qs AS (SELECT l_orderkey AS oq, arg_min(qid, qid) AS first FROM it JOIN res ON res.qid = it.id GROUP BY 1), "
    "hits AS (SELECT oq AS qid, it.id, it.ip, it.iu, 1.0 + it.id % 7 AS score, CAST(it.ln AS INTEGER) AS rk, r.phase, r.urgency, "
    "r.phase_confidence AS pc, r.urgency_confidence AS uc FROM qs JOIN res r ON r.qid = qs.first JOIN it ON it.l_orderkey = qs.oq), "
    "b AS (SELECT *, CASE WHEN phase = 'unknown' OR pc <= 0.6 THEN 1.0 WHEN ip = phase THEN 1.5 WHEN phase = 'initial' AND ip = "
    "'surveillance' THEN 0.5 WHEN phase = 'surveillance' AND ip = 'initial' THEN 0.7 ELSE 1.0 END * CASE WHEN urgency = 'unknown' OR uc "
    "<= 0.6 THEN 1.0 WHEN iu = urgency THEN 1.3 WHEN urgency = 'acute' AND iu = 'routine' THEN 0.6 ELSE 1.0 END AS bo FROM hits) "
    "SELECT qid, id, score, round(CASE WHEN phase = 'unknown' THEN 1.0 ELSE bo END, 6) AS boost, CAST(rank AS INTEGER) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN phase = 'unknown' THEN 0 ELSE score * bo END, 9) DESC, rk) "
    "AS rank FROM b) WHERE rank <= 5",
)
def intent_reranked(spark, sf):
    """Lines of an order re-ranked by the intent of its first line."""
    items = lines(spark, sf).withColumn("o", F.floor(F.col("qid") / 16))
    c = classified(spark, sf)
    first = items.groupBy("o").agg(F.min("qid").alias("first"))
    intents = first.join(c, F.col("first") == c.qid).select(
        F.col("o").alias("qid"), "phase", "urgency", "phase_confidence", "urgency_confidence"
    )
    hits = items.select(
        F.col("o").alias("qid"), F.col("qid").alias("id"), (F.lit(1.0) + F.col("qid") % 7).alias("score"),
        (F.col("qid") % 16).cast("int").alias("rank"),
    )
    ranked = intent.rerank_by_intent(
        hits, intents, items.select(F.col("qid").alias("id"), F.col("text").alias("name")), 5, NAME_PHASES, NAME_URGENCIES
    )
    return ranked.withColumn("boost", F.round("boost", 6))


TRIGGERS = [
    (r"hot|red", [("Acute?", "urgent high"), ("Chronic?", "low medium")]),
    (r"bolt|ring", [("Small?", "small tiny"), ("New?", "new fresh")]),
    (r"gear", [("Old?", "old worn"), ("Priority?", "specified")]),
]


@query(
    "ambiguous_queries",
    sql=f"WITH {LINES}, q AS (SELECT qid, lower(text) AS q FROM l), t AS (SELECT qid, "
    + "CASE "
    + " ".join(
        f"WHEN regexp_matches(q, '{p}') AND NOT (" + " OR ".join(f"contains(q, '{w}')" for _, v in o for w in v.split()) + f") THEN {i}"
        for i, (p, o) in enumerate(TRIGGERS)
    )
    + " END AS t FROM q), "
    + values_sql("op", "t, pos, label, value", [(i, j + 1, lb, v) for i, (_, o) in enumerate(TRIGGERS) for j, (lb, v) in enumerate(o)])
    + " SELECT t.qid, pos, label, value, l.text || ' ' || value AS refined FROM t JOIN op USING (t) JOIN l USING (qid)",
)
def ambiguous_queries(spark, sf):
    rows = lines(spark, sf)
    options = detect_ambiguity(rows, TRIGGERS)
    return refine_query(options, F.col("text"), F.col("value")).select("qid", "pos", "label", "value", "refined")


VOCABULARY = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "the": 4, "of": 5, "de": 6, "la": 7, "der": 8}


@query(
    "token_ids",
    sql="WITH t AS (SELECT conv_id, turn, list_slice(regexp_extract_all(lower(text), '\\w(?:[\\w/-]*\\w)?'), 1, 30) AS toks FROM conversations), "
    "b AS (SELECT conv_id, turn, list_concat([2], list_transform(toks, lambda x: CASE "
    + " ".join(f"WHEN x = {literal(word)} THEN {number}" for word, number in VOCABULARY.items())
    + " ELSE 1 END), [3]) AS ids FROM t) "
    "SELECT conv_id, turn, list_resize(ids, 32, 0) AS ids, list_resize(list_transform(ids, lambda x: 1), 32, 0) AS mask FROM b",
)
def token_ids(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", intent.token_ids(F.col("text"), VOCABULARY).alias("t")).select("conv_id", "turn", "t.ids", "t.mask")
