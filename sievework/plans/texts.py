"""Text jobs over documents, pages, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packs
from ..functions import text as tx
from ..functions.rules import all_labels, best_class, context_map, first_alias, first_label, Rule
from ..operators import titles
from ..session import spread, table
from .registry import literal, norm_sql, query

TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


def pages(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", "html", title)


def parts(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )


@query("normalised_text", sql=f"SELECT doc_id AS id, md5({norm_sql('text')}) AS digest FROM documents")
def normalised_text(spark, sf):
    return docs(spark, sf).select("id", F.md5(tx.norm(F.col("text"))).alias("digest"))


SLUG = (
    "trim(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(lower({x}), 'w/o', 'wo'), 'w/', 'w'), '/', ''), "
    "'&', 'and'), '[^a-z0-9 ]', '', 'g'), ' ', '-'), '-+', '-', 'g'), '-')"
)


@query("slugs", sql=f"SELECT page_id AS id, {SLUG.format(x=TITLE)} AS slug FROM pages")
def slugs(spark, sf):
    return pages(spark, sf).select("id", tx.slugify(F.col("title")).alias("slug"))


def title_sql(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|\\P{{L}}+)'), lambda r: upper(r[1]) || r[2:]), '')"
    )


def display_sql(x: str) -> str:
    s = title_sql(
        f"regexp_replace(regexp_replace(regexp_replace({x}, '\\bW/WO\\b', 'With and Without', 'gi'), '\\bW/O\\b', 'Without', 'gi'), "
        "'\\bW/([^Oo]|$)', 'With\\1', 'gi')"
    )
    for a, b in tx.ACRONYMS:
        s = f"regexp_replace({s}, '\\b{a}\\b', '{b}', 'g')"
    return s


LONG_SQL = "'mri ' || p_name || CASE p_type WHEN 'SMALL' THEN ' W/O ' WHEN 'PROMO' THEN ' w/wo ' ELSE ' W/ ' END || 'contrast ct-' || lower(p_type)"


@query(
    "display_names",
    sql=f"WITH n AS (SELECT p_partkey AS id, {LONG_SQL} AS n, p_brand AS s FROM part) SELECT id, {display_sql('n')} || CASE WHEN "
    f"contains(lower(n), lower(s)) THEN '' ELSE ' (' || {display_sql('s')} || ')' END AS name FROM n",
)
def display_names(spark, sf):
    mark = F.when(F.col("p_type") == "SMALL", " W/O ").when(F.col("p_type") == "PROMO", " w/wo ").otherwise(" W/ ")
    name = F.concat(F.lit("mri "), "p_name", mark, F.lit("contrast ct-"), F.lower("p_type"))
    return parts(spark, sf).select("id", tx.display_with_short(name, F.col("p_brand")).alias("name"))


@query(
    "word_titles",
    sql="SELECT id, array_to_string(list_transform(regexp_split_to_array(t, '[\\t\\n\\x0b\\f\\r ]+'), lambda w: replace(upper(w[1]), "
    f"'ẞ', 'SS') || lower(w[2:])), ' ') AS title FROM (SELECT page_id AS id, {TITLE} AS t FROM pages)",
)
def word_titles(spark, sf):
    return pages(spark, sf).select("id", tx.word_title(F.col("title")).alias("title"))


@query(
    "page_meta",
    sql="SELECT page_id AS id, left(t, 155) AS meta, length(t) AS chars FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]+>', "
    "'', 'g')) AS t FROM pages)",
)
def page_meta(spark, sf):
    plain = pages(spark, sf).select("id", tx.strip_tags(F.col("html")).alias("t"))
    return plain.select("id", F.substring("t", 1, 155).alias("meta"), F.length("t").cast("long").alias("chars"))


@query(
    "escaped_highlighted",
    sql="SELECT id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, regexp_replace(t, '(' || h || "
    "')', '<mark>\\1</mark>', 'gi') AS marked FROM (SELECT page_id AS id, "
    f"{TITLE} AS t, regexp_extract(url, '//(m\\.|www\\.)?([a-z]+)', 2)[1:3] AS h FROM pages)",
)
def escaped_highlighted(spark, sf):
    host = F.substring(F.regexp_extract("url", r"//(m\.|www\.)?([a-z]+)", 2), 1, 3)
    return pages(spark, sf).select(
        "id", tx.escape_html(F.col("title")).alias("escaped"), tx.highlight(F.col("title"), host).alias("marked")
    )


@query(
    "truncated_text",
    sql="SELECT doc_id AS id, CASE WHEN length(text) <= 30 THEN text ELSE left(text, 27) || '...' END AS short FROM documents",
)
def truncated_text(spark, sf):
    return docs(spark, sf).select("id", tx.truncate(F.col("text"), 30).alias("short"))


@query("cache_keys", sql="SELECT doc_id AS id, left(md5(text), 16) AS key FROM documents")
def cache_keys(spark, sf):
    return docs(spark, sf).select("id", tx.cache_key(F.col("text")).alias("key"))


@query(
    "time_texts",
    sql="SELECT event_id AS id, CASE WHEN s = 0 THEN '0 min' WHEN floor(s / 60.0 + 0.5) < 1 THEN '<1 min' ELSE CAST(CAST(floor(s / "
    "60.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' END AS duration, CAST(CAST(floor(s / 60.0 + 0.5) AS BIGINT) AS VARCHAR) || '-' "
    "|| CAST(CAST(floor(s * 2 / 60.0 + 0.5) AS BIGINT) AS VARCHAR) || ' min' AS span FROM (SELECT event_id, CAST(floor(value * 10) "
    "AS BIGINT) AS s FROM events)",
)
def time_texts(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.floor(F.col("value") * 10).alias("s"))
    return e.select("id", tx.minutes_text(F.col("s")).alias("duration"), tx.range_text(F.col("s"), F.col("s") * 2).alias("span"))


PLANES = [("STANDARD", "AX"), ("ECONOMY", "SAG"), ("MEDIUM", "COR"), ("PROMO", "3D")]


@query(
    "sequence_names",
    sql="SELECT p_partkey AS id, CASE p_type WHEN 'STANDARD' THEN 'AX' WHEN 'ECONOMY' THEN 'SAG' WHEN 'MEDIUM' THEN 'COR' WHEN "
    "'PROMO' THEN '3D' ELSE upper(p_type) END || ' ' || p_name AS name, p_brand || '_' || p_type AS sequence_id FROM part",
)
def sequence_names(spark, sf):
    plane = first_alias(F.col("p_type"), PLANES, F.upper("p_type"))
    return parts(spark, sf).select(
        "id", F.concat_ws(" ", plane, "p_name").alias("name"), F.concat_ws("_", "p_brand", "p_type").alias("sequence_id")
    )


@query(
    "key_terms",
    sql="SELECT id, CASE WHEN len(k) > 0 THEN CASE WHEN h <> '' THEN h ELSE array_to_string(k, ' ') END END AS terms FROM (SELECT "
    "doc_id AS id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\\s\\-]', '', 'g'), '\\s+'), lambda "
    f"w: length(w) > 2 AND w NOT IN ({', '.join(literal(w) for w in tx.STOP_WORDS)})) AS k, regexp_extract(text, "
    "'([A-Za-z0-9_]+-[A-Za-z0-9_]+)', 1) AS h FROM documents)",
)
def key_terms(spark, sf):
    return docs(spark, sf).select("id", tx.key_terms(F.col("text")).alias("terms"))


@query(
    "lead_sentences",
    sql="SELECT id, CASE WHEN length(l) <= 250 THEN l ELSE left(l, 247) || '...' END AS lead FROM (SELECT id, CASE WHEN len(s) > 0 "
    "THEN trim(array_to_string(s[1:2], ' ')) ELSE p END AS l FROM (SELECT id, p, regexp_extract_all(p, '[^.!?]+[.!?]+') AS s FROM "
    "(SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(regexp_replace(regexp_replace(text, '#{1,6}\\s*', '', 'g'), '\\*', "
    "'', 'g'), '\\n+', ' ', 'g')) AS p FROM conversations)))",
)
def lead_sentences(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return c.select("id", tx.lead_sentences(F.col("text")).alias("lead"))


def _items_sql(x, lead):
    return (
        f"list_filter(list_transform(regexp_extract_all(t, '{x}')[1:3], lambda m: trim(regexp_replace(regexp_replace(m, '{lead}', ''), "
        "'\\*?\\*?$', ''))), lambda m: length(m) > 2 AND length(m) < 100)"
    )


@query(
    "list_items",
    sql="SELECT id, CASE WHEN len(n) > 0 THEN n ELSE b END AS items FROM (SELECT id, "
    + _items_sql("[0-9]+\\.\\s*\\*?\\*?[^:\\n]+", "^[0-9]+\\.\\s*\\*?\\*?") + " AS n, "
    + _items_sql("[-*]\\s*\\*?\\*?[^:\\n]+", "^[-*]\\s*\\*?\\*?")
    + " AS b FROM (SELECT doc_id AS id, text AS t FROM documents))",
)
def list_items(spark, sf):
    return docs(spark, sf).select("id", tx.list_items(F.col("text")).alias("items"))


@query(
    "embedded_json",
    sql="SELECT event_id AS id, regexp_extract(r, '(?s)(\\{.*\\})', 1) AS body, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS "
    "INTEGER) AS k FROM (SELECT event_id, props, 'reply to ' || event_type || ': ' || props || ' end' AS r FROM events)",
)
def embedded_json(spark, sf):
    reply = F.concat(F.lit("reply to "), "event_type", F.lit(": "), "props", F.lit(" end"))
    body = table(spark, sf, "events").select(F.col("event_id").alias("id"), tx.embedded_json(reply).alias("body"))
    return body.select("id", "body", F.from_json("body", "k int")["k"].alias("k"))


EQ_RULES = [(r"\b(of|the|and|or)\b", ""), (r"\bwidget\b", "gizmo"), (r"\bold\b", "worn"), (r"\bnew\b", "fresh")]


def eq_sql(x: str) -> str:
    s = f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    for p, r in EQ_RULES:
        s = f"regexp_replace({s}, '{p}', '{r}', 'gi')"
    return f"array_to_string(list_sort(string_split(trim(regexp_replace({s}, '\\s+', ' ', 'g')), ' ')), ' ')"


EQ_NAME = "p_name || ' of the ' || p_type"


@query("equivalence_keys", sql=f"SELECT p_partkey AS id, {eq_sql(EQ_NAME)} AS key FROM part")
def equivalence_keys(spark, sf):
    name = F.concat("p_name", F.lit(" of the "), "p_type")
    return parts(spark, sf).select("id", titles.equivalence_key(name, EQ_RULES).alias("key"))


@query(
    "near_duplicate_drop",
    sql="WITH RECURSIVE p AS (SELECT page_id AS seq, regexp_extract(url, '//(m\\.|www\\.)?([a-z]+)', 2) AS host, "
    f"{eq_sql(TITLE)} AS key FROM pages), o AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS rn FROM p), "
    "r AS (SELECT host, rn, [key] AS kept, TRUE AS stays FROM o WHERE rn = 1 UNION ALL SELECT host, rn, CASE WHEN ok THEN list_append(kept, key) ELSE kept "
    "END, ok FROM (SELECT o.host, o.rn, o.key, r.kept, len(list_filter(r.kept, lambda k: (contains(k, o.key) OR contains(o.key, k)) AND "
    "abs(length(k) - length(o.key)) < 5)) = 0 AS ok FROM r JOIN o ON o.host = r.host AND o.rn = r.rn + 1)) "
    "SELECT o.host, o.key, o.seq FROM o JOIN r USING (host, rn) WHERE stays",
)
def near_duplicate_drop(spark, sf):
    """Greedy pass per page host over page titles."""
    rows = pages(spark, sf).select(
        F.regexp_extract("url", r"//(m\.|www\.)?([a-z]+)", 2).alias("host"),
        titles.equivalence_key(F.col("title"), EQ_RULES).alias("key"),
        F.col("id").alias("seq"),
    )
    return titles.drop_equivalent(rows, "host", "key", "seq")


# qualifier classes and rewrites over syllables of the test prose
CLASSES = [
    ("skip", "", ["nextim"]), ("size", "[0-9]+", []), ("severity", "", ["whou", "elle"]), ("subtype", "", ["tionon"]),
    ("body", "", ["hea", "chtig"]), ("clinical", "", ["erth", "eau", "und"]), ("imaging", "", ["ing", "ment"]),
    ("purpose", "", ["ent", "que"]),
]
SHORT = [("tion", "t."), ("the ", ""), ("ment", "m.")]


def _format_sql(t: str) -> str:
    cls = "CASE " + " ".join(
        "WHEN "
        + " OR ".join([f"contains(lower(q), {literal(w)})" for w in ws] + ([f"regexp_matches(lower(q), '{rx}')"] if rx else []))
        + f" THEN '{n}'"
        for n, rx, ws in CLASSES
    ) + " ELSE 'other' END"
    short = "q"
    for a, b in SHORT:
        short = f"regexp_replace({short}, '{a}', '{b}', 'gi')"

    def of(n, k=None):
        s = f"list_transform(list_filter(tg, lambda t: t.c = '{n}'), lambda t: t.q)"
        return s if k is None else f"({s})[1:{k}]"

    return (
        f"WITH n AS (SELECT id, title, list_transform(string_split(title, ','), lambda p: trim(p, ' ')) AS parts FROM ({t})), "
        f"g AS (SELECT id, title, parts, list_transform(parts[2:], lambda q: {{'c': {cls}, 'q': q}}) AS tg FROM n), "
        f"c AS (SELECT *, {of('body')} AS body, {of('size')} || {of('severity', 1)} || CASE WHEN len({of('severity')}) > 0 THEN "
        f"{of('purpose', 1)} ELSE [] END || {of('subtype', 1)} || {of('clinical', 2)} || CASE WHEN len({of('severity')}) > 0 THEN [] "
        f"ELSE {of('purpose', 1)} END AS core FROM g), "
        f"i AS (SELECT *, CASE WHEN len(core) < 3 THEN core || {of('imaging', 1)} ELSE core END AS wi FROM c), "
        f"s AS (SELECT *, list_transform((CASE WHEN len(wi) > 0 THEN wi ELSE {of('other', 2)} END)[1:4], lambda q: {short}) AS sh "
        "FROM i) SELECT id, CASE WHEN len(parts) <= 2 THEN title ELSE parts[1] || CASE WHEN len(body) > 0 THEN ' - ' || "
        "array_to_string(body, '/') ELSE '' END || CASE WHEN len(sh) > 0 THEN ' (' || array_to_string(sh, ', ') || ')' ELSE '' END "
        "END AS formatted FROM s"
    )


TURN_SQL = "SELECT conv_id * 1000 + turn AS id, text AS title FROM conversations"


@query("formatted_titles", sql=_format_sql(TURN_SQL))
def formatted_titles(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return c.select("id", titles.format_title(F.col("text"), CLASSES, SHORT).alias("formatted"))


@query(
    "differentiators",
    sql="SELECT id, array_to_string(CASE WHEN len(k) > 2 THEN k[-2:] WHEN len(k) > 0 THEN k ELSE r END, ', ') AS differs FROM (SELECT "
    "id, r, list_filter(r, lambda p: NOT contains(lower(p), 'und') AND NOT contains(lower(f), left(lower(p), 10))) AS k FROM (SELECT "
    "n.id, f.formatted AS f, list_transform(string_split(n.title, ','), lambda p: trim(p, ' '))[2:] AS r FROM "
    f"({TURN_SQL}) n JOIN ({_format_sql(TURN_SQL)}) f USING (id)))",
)
def differentiators(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    shown = titles.format_title(F.col("text"), CLASSES, SHORT)
    return c.withColumn("shown", shown).select(
        "id", titles.differentiator(F.col("text"), F.col("shown"), ["und"]).alias("differs")
    )


# phase and context patterns over the test prose
PHASES = [
    ("screening", [r"\bthe\b.*\bof\b", r"\bthat\b"]), ("initial", [r"\bis\b", r"\bder\b", r"\bque\b"]),
    ("pretreatment", [r"\bder\b.*\bund\b", r"\bwas\b", r"\bvon\b"]), ("surveillance", [r"\bwith\b", r"\bles\b", r"\bel\b"]),
]
CONTEXTS = [
    ("article", [("definite", r"\bthe\b|\bder\b"), ("plural", r"\bles\b|\blos\b")]), ("verb", [("being", r"\bis\b|\best\b"), ("having", r"\bha\w+\b")]),
]
LABELS = [
    Rule("english", any_of=("the ", " of "), none_of=(" der ",)), Rule("german", all_of=(" der ", " und ")),
    Rule("french", any_of=(" que ", " les ")), Rule("table", regex=r"\|"),
]


def phase_sql(x: str, phases=PHASES) -> str:
    counts = [(n, " + ".join(f"CAST(regexp_matches({x}, '{p}') AS INTEGER)" for p in ps)) for n, ps in phases]
    top = "greatest(" + ", ".join(c for _, c in counts) + ")"
    return f"CASE WHEN {top} = 0 THEN 'initial' " + " ".join(f"WHEN {c} = {top} THEN '{n}'" for n, c in counts) + " END"


def context_value_sql(x: str, values) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{v}'" for v, p in values) + " END"


def rule_sql(x: str, r: Rule) -> str:
    conds = [f"contains({x}, {literal(w)})" for w in r.all_of] + [f"NOT contains({x}, {literal(w)})" for w in r.none_of]
    if r.any_of:
        conds.append("(" + " OR ".join(f"contains({x}, {literal(w)})" for w in r.any_of) + ")")
    if r.regex:
        conds.append(f"regexp_matches({x}, '{r.regex}')")
    return " AND ".join(conds)


@query(
    "phase_and_context",
    sql=f"SELECT id, {phase_sql('l')} AS phase, {context_value_sql('l', CONTEXTS[0][1])} AS article, "
    f"{context_value_sql('l', CONTEXTS[1][1])} AS verb FROM (SELECT doc_id AS id, lower(text) AS l FROM documents)",
)
def phase_and_context(spark, sf):
    low = docs(spark, sf).select("id", F.lower("text").alias("l"))
    return low.select(
        "id", best_class(F.col("l"), PHASES, "initial").alias("phase"), context_map(F.col("l"), CONTEXTS).alias("m")
    ).select("id", "phase", F.try_element_at("m", F.lit("article")).alias("article"), F.try_element_at("m", F.lit("verb")).alias("verb"))


@query(
    "rule_labels",
    sql="SELECT id, CASE " + " ".join(f"WHEN {rule_sql('l', r)} THEN '{r.label}'" for r in LABELS)
    + " ELSE 'none' END AS first_label, list_filter([" + ", ".join(f"CASE WHEN {rule_sql('l', r)} THEN '{r.label}' END" for r in LABELS)
    + "], lambda x: x IS NOT NULL) AS labels FROM (SELECT doc_id AS id, lower(text) AS l FROM documents)",
)
def rule_labels(spark, sf):
    low = docs(spark, sf).select("id", F.lower("text").alias("l"))
    return low.select(
        "id", first_label(F.col("l"), LABELS, "none").alias("first_label"), all_labels(F.col("l"), LABELS).alias("labels")
    )


@query(
    "numbered_batches",
    sql="WITH r AS (SELECT p_type, p_partkey, p_name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) "
    "SELECT p_type, CAST((n - 1) // 20 AS BIGINT) AS batch, string_agg(CAST((n - 1) % 20 + 1 AS VARCHAR) || '. [' || p_partkey || "
    "'] ' || p_name, chr(10) ORDER BY n) AS body FROM r GROUP BY ALL",
)
def numbered_batches(spark, sf):
    from ..operators.texts import numbered_batches as run

    rows = parts(spark, sf).select("p_type", F.col("id"), F.col("p_name").alias("name"))
    return run(rows, ["p_type"], "id", "name", 20)


@query(
    "parsed_replies",
    sql="WITH r AS (SELECT p_type, p_partkey, p_size, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) "
    "SELECT p_type, CAST((n - 1) // 20 AS BIGINT) AS batch, CAST((n - 1) % 20 + 1 AS INTEGER) AS idx, CAST(p_size AS INTEGER) / 10.0 "
    "AS score FROM r WHERE p_size <= 10",
)
def parsed_replies(spark, sf):
    from ..operators.texts import numbered_batches as run
    from ..operators.texts import parse_scores

    rows = parts(spark, sf).select("p_type", F.col("id"), F.col("p_size").cast("string").alias("name"))
    batches = run(rows, ["p_type"], "id", "name", 20)
    bare = batches.withColumn("body", F.regexp_replace("body", r"\[[0-9]+\] ", ""))
    return parse_scores(bare, "body").select("p_type", "batch", "idx", "score")


REGISTRY_NAME = "concat_ws(' ', 'MR', CASE p_type WHEN 'STANDARD' THEN ' Head' WHEN 'ECONOMY' THEN 'Cervical Spine' WHEN 'MEDIUM' THEN 'Headrest' ELSE p_type END, p_name, {c})"
CONTRASTS = ["WITHOUT IV contrast", "with IV contrast ", "without and with IV contrast"]


def registry_sql() -> str:
    x = "lower(trim(n))"
    for a, b in packs.REGISTRY_CONTRAST:
        x = f"replace({x}, '{a}', '{b}')"
    for a, b in packs.REGISTRY_PARTS:
        x = f"regexp_replace({x}, '\\b{a}\\b', '{b}', 'g')"
    return f"regexp_replace({x}, '\\s+', ' ', 'g')"


@query(
    "canonical_names",
    sql="SELECT id, " + registry_sql() + " AS name FROM (SELECT p_partkey AS id, "
    + REGISTRY_NAME.format(c=f"CASE p_size % 3 WHEN 0 THEN '{CONTRASTS[0]}' WHEN 1 THEN '{CONTRASTS[1]}' ELSE '{CONTRASTS[2]}' END") + " AS n FROM part)",
)
def canonical_names(spark, sf):
    size = F.col("p_size") % 3
    contrast = F.when(size == 0, CONTRASTS[0]).when(size == 1, CONTRASTS[1]).otherwise(CONTRASTS[2])
    kind = F.when(F.col("p_type") == "STANDARD", " Head").when(F.col("p_type") == "ECONOMY", "Cervical Spine").when(F.col("p_type") == "MEDIUM", "Headrest")
    name = F.concat_ws(" ", F.lit("MR"), F.coalesce(kind, "p_type"), "p_name", contrast)
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), tx.canonical_name(name, packs.REGISTRY_CONTRAST, packs.REGISTRY_PARTS).alias("name"))
