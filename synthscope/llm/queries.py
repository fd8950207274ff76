"""One query per operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, editembed, licenses, mixing, pii, quality, repair, runs, simhash, suffix, topk, urls
from .common import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii(spark, sf_dir):
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op4_urls(spark, sf_dir):
    return urls.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_licenses(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in TRICKY])).alias("r")).select("r.*")
    return chat.chat_digests(chat.format_chats(rows.unionByName(extra)))


def op7_quality(spark, sf_dir):
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_suffix(spark, sf_dir):
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_editembed(spark, sf_dir):
    return editembed.grouped_fingerprints(_table(spark, sf_dir, "documents"))


def op10_decontam(spark, sf_dir):
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows.where("vec_id % 20 = 0"), rows, k=20, scale=64.0)


def _with_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32 of the id ends in 0, the words from a on repeat the first p of them. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (h % 10 == 0).alias("repeats"), F.floor(h / 10).alias("g"))
    words = cut.withColumn("words", F.when(F.col("repeats"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn("n", F.size("words"))
    placed = words.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    new = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(F.array_repeat(period, times))), F.lit(1), F.col("n"))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir):
    return runs.run_digests(runs.periodic_runs(_with_runs(_table(spark, sf_dir, "documents"))))


def op13_repair(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return repair.repair_conversations(repair.damage(rows), rows)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_pii, op4_urls, op5_licenses, op6_chat, op7_quality, op8_suffix, op9_editembed, op10_decontam, op11_topk, op12_runs, op13_repair)}


# --- SQL --------------------------------------------------------------------------------

_WORD = r"'[^\x20\x09-\x0D]+'"


def _mixing_sql() -> str:
    weights = "CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
    return rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
  ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, text, 'null')), 1, 13))::BIGINT % {mixing.STEPS} AS coin FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, {weights} AS weight FROM totals),
placed AS (SELECT *, source_size / weight AS reach, row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS place FROM weighed),
run AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
  coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS gone, (sum(source_size) OVER ())::BIGINT AS total, sum(weight) OVER () AS all_weight FROM placed),
levels AS (SELECT *, (total - 3.0::DOUBLE * stopped) / (all_weight - gone) AS level FROM run),
final AS (SELECT place AS p, level AS l FROM levels WHERE level <= 3.0::DOUBLE * reach ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN place < coalesce((SELECT p FROM final), 2147483647) THEN 3.0::DOUBLE * source_size ELSE (SELECT l FROM final) * weight END AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
coins AS (SELECT source, coin, sum(size)::BIGINT AS size FROM sized GROUP BY source, coin),
middles AS (SELECT source, coin, coalesce(sum(size) OVER (PARTITION BY source ORDER BY coin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2.0::DOUBLE AS middle FROM coins),
ends AS (SELECT r.source, coalesce(max(CASE WHEN middle < (rate - floor(rate)) * source_size THEN coin + 1 END), 0) AS threshold FROM middles m JOIN rates r ON m.source IS NOT DISTINCT FROM r.source GROUP BY r.source)
SELECT s.doc_id, s.size, r.source_size, r.target, ((floor(rate)::BIGINT + (s.coin < e.threshold)::BIGINT) * s.size)::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source JOIN ends e ON s.source IS NOT DISTINCT FROM e.source
"""


def _urls_sql() -> str:
    """Hosts, paths and rules; and the two PageRanks, a round at a time."""
    low = "translate(regexp_extract({}, '{}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR suffix(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{k(r)}'" for r in rules) + " END"
    link = urls.LINK.replace("'", "''")
    steps = []
    for kind, src, dst in (("allow", "src", "dst"), ("block", "dst", "src")):
        seed = f"seed_{kind}"
        steps.append(f"{seed} AS (SELECT host, count(*)::DOUBLE / (SELECT count(*) FROM parts WHERE ruled = '{kind}' AND host <> '') AS seed FROM parts WHERE ruled = '{kind}' AND host <> '' GROUP BY host)")
        steps.append(f"edge_{kind} AS (SELECT {src} AS src, {dst} AS dst, count(*) OVER (PARTITION BY {src}) AS n FROM links)")
        steps.append(f"r_{kind}_0 AS (SELECT host, seed AS score FROM {seed})")
        for k in range(urls.ROUNDS):
            steps.append(
                f"r_{kind}_{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT e.dst AS host, sum({urls.DAMPING}::DOUBLE * r.score / e.n) AS score FROM edge_{kind} e JOIN r_{kind}_{k} r ON e.src = r.host GROUP BY e.dst "
                f"UNION ALL SELECT host, (1 - {urls.DAMPING}::DOUBLE) * seed FROM {seed}) GROUP BY host)"
            )
    return f"""
WITH cut AS (SELECT page_id, coalesce({low.format("url", "(?s)^.*?://([^/?#]*)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
parts AS (SELECT *, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS ruled FROM cut),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM parts WHERE host <> ''),
links AS (SELECT DISTINCT src, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM found WHERE src <> translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')),
{", ".join(steps)}
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.ruled, CASE WHEN coalesce(b.score, 0) > {urls.THRESHOLD}::DOUBLE * coalesce(a.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN r_allow_{urls.ROUNDS} a ON p.host = a.host LEFT JOIN r_block_{urls.ROUNDS} b ON p.host = b.host
"""


def _licenses_sql() -> str:
    """Every template laid over the words wherever a required bigram stands, by plain Dice; of finds that overlap, the best."""
    known = licenses.prepared(licenses.TEMPLATES, licenses.THRESHOLD)
    quoted = lambda items: "[{}]".format(", ".join(f"'{g}'" for g in items))
    templates = ", ".join(f"({k}, '{t.license}', {t.words}, {quoted(t.grams)})" for k, t in enumerate(known))
    anchors = ", ".join(f"('{g}', {k}, {o})" for k, t in enumerate(known) for g, o in t.anchors)
    by = "PARTITION BY d ORDER BY start_word, n_words DESC ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
WITH templates(k, license, m, t) AS (VALUES {templates}),
anchors(gram, k, o) AS (VALUES {anchors}),
worded AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
words AS (SELECT d, unnest(w) AS x, unnest(range(len(w))) AS i FROM worded),
pairs AS (SELECT d, i, x || ' ' || lead(x) OVER (PARTITION BY d ORDER BY i) AS gram FROM words),
laid AS (SELECT DISTINCT d, k, i - o AS s FROM pairs JOIN anchors USING (gram)),
stretches AS (SELECT d, doc_id, license, t, greatest(s, 0) AS start_word, list_slice(w, greatest(s, 0) + 1, least(s + m, len(w))) AS v FROM laid JOIN worded USING (d) JOIN templates USING (k)),
grams AS (SELECT *, len(v) AS n_words, list_distinct([v[j] || ' ' || v[j + 1] for j in range(1, len(v))]) AS g FROM stretches),
scored AS (SELECT d, doc_id, license, start_word, n_words, len(list_intersect(g, t)) AS shared, 2 * len(list_intersect(g, t)) / (len(g) + len(t))::DOUBLE AS dice FROM grams),
found AS (SELECT * FROM scored WHERE dice >= {licenses.THRESHOLD} - 1e-12),
begun AS (SELECT *, coalesce(start_word >= max(start_word + (n_words + 1) // 2) OVER ({by} 1 PRECEDING) AND start_word + n_words > max(start_word + n_words) OVER ({by} 1 PRECEDING), true) AS apart FROM found),
numbered AS (SELECT *, sum(apart::INT) OVER ({by} CURRENT ROW) AS find FROM begun),
ranked AS (SELECT *, row_number() OVER (PARTITION BY d, find ORDER BY shared DESC, dice DESC, start_word, license, n_words) AS place FROM numbered)
SELECT doc_id, start_word::BIGINT AS start_word, n_words::BIGINT AS n_words, license, dice FROM ranked WHERE place = 1
"""


def _decontam_sql() -> str:
    """Exact containment of every item's five-word runs (of all its words, if it has fewer) in every document's."""
    worded = lambda table, key: rf"SELECT DISTINCT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM {table} WHERE {key} IS NOT NULL"
    runs = lambda key: f"SELECT DISTINCT {key}, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT {key}, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM"
    return f"""
WITH tests AS (SELECT item_id, w, least(5, len(w)) AS k FROM ({worded("benchmark", "item_id")}) WHERE len(w) > 0),
items AS ({runs("item_id")} tests)),
held AS ({runs("doc_id")} ({worded("documents", "doc_id")}), (SELECT DISTINCT k FROM tests))),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM held JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item::DOUBLE AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared >= greatest(1, ceil({decontam.CONTAINED} * n_item - 1e-9))
"""


def _chat_sql() -> str:
    """Digests of the turns as they are, and the length of the formatted text; the machine as a pattern over roles."""
    t = chat.TEMPLATE
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    escaped = lambda c: _nested(c, [("\\", "\\\\"), *[(x, f"\\{k};") for k, x in enumerate(t.controls)]], quote)
    marks = " ".join(f"WHEN role = {quote(r)} THEN {len(t.before[r]) + len(t.after[r])}" for r in t.before)
    other = f"{sum(map(len, t.other))} + length({escaped('role')})"
    letter = "CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END"
    extra = " UNION ALL ".join(f"SELECT {c}, {n}, {quote(r)}, {quote(x)}" for c, n, r, x in TRICKY)
    by = "ORDER BY turn NULLS FIRST, role, text"
    said = f"coalesce(string_agg(text, '' {by}) FILTER (role = 'assistant'), '')"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {by})) AS turns_sha256, length({said})::BIGINT AS loss_chars, sha256({said}) AS loss_sha256,
  sum(CASE {marks} ELSE {other} END + length({escaped('text')}))::BIGINT AS formatted_chars, regexp_full_match(string_agg({letter}, '' {by}), 's?(ua)+') AS valid
FROM turns GROUP BY conv_id
"""


def _nested(column: str, pairs: list[tuple[str, str]], quote) -> str:
    for a, b in pairs:
        column = f"replace({column}, {quote(a)}, {quote(b)})"
    return column


def _topk_sql() -> str:
    """Every query with every other row."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= 20
"""


def _repair_sql() -> str:
    """Damage, faults, and the edits row by row for all conversations at once: the least (cost, audit) of each state of the pattern."""
    crc_step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda t, x: list_reduce(range(8), lambda c, i: {crc_step}, xor(t, x)), 4294967295), 4294967295)"
    blank, cut = r"text NOT SIMILAR TO '(?s).*[^\x20\x09-\x0D].*'", r"regexp_extract(text, '(?s)^.*([^\x20\x09-\x0D])', 1) NOT IN ('.', '!', '?')"
    edge = lambda state, cost, letter: f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}} END"
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))"
    keep = lambda state, initial: f"CASE WHEN may AND initial = '{initial}' THEN {edge(state, 'extra', 'K')} END"
    rename = lambda state: f"CASE WHEN may THEN {edge(state, '1 + extra', 'R')} END"
    drop = lambda state: edge(state, 2, "D")
    return rf"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM base),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (SELECT *, {blank} AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, {cut} AS cut FROM numbered),
faults AS MATERIALIZED (SELECT conv_id, turn, role, text, i, blank, NOT blank AND again AS duplicate, NOT blank AND NOT again AND cut AS truncated, left(role, 1) AS initial,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
edits AS (SELECT coalesce(conv_id, -9223372036854775808) AS conv, i, initial, NOT blank AND NOT duplicate AS may, CASE WHEN truncated THEN 5 ELSE 0 END AS extra FROM faults),
none AS (SELECT NULL::STRUCT(c BIGINT, a VARCHAR) AS x),
steps AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS n, (SELECT x FROM none) AS s, {{'c': 5::BIGINT, 'a': 'I'}} AS u, {{'c': 10::BIGINT, 'a': 'II'}} AS a FROM edits
  UNION ALL
  SELECT conv, i, n, s, {least('u1', edge('n', 5, 'I'), edge('s', 5, 'I'), edge('a1', 5, 'I'))} AS u, {least('a1', edge(least('u1', edge('n', 5, 'I'), edge('s', 5, 'I')), 5, 'I'))} AS a FROM (
    SELECT e.conv, e.i, {drop('n')} AS n, {least(drop('s'), keep('n', 's'))} AS s,
      {least(drop('u'), *[x for state in 'nsa' for x in (keep(state, 'u'), rename(state))])} AS u1, {least(drop('a'), keep('u', 'a'), rename('u'))} AS a1
    FROM steps t JOIN edits e ON e.conv = t.conv AND e.i = t.i + 1)),
ends AS (SELECT conv, {least('n', 'a')} AS e FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1)),
letters AS (SELECT conv, unnest(range(1, length(e.a) + 1)) AS p, e.a AS audit FROM ends),
read AS (SELECT conv, p, substr(audit, p, 1) AS x, p - (length(substr(audit, 1, p)) - length(replace(substr(audit, 1, p), 'I', ''))) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS place FROM letters),
spoken AS (SELECT r.conv, r.x, r.place, coalesce(f.role, '') AS role, CASE WHEN r.x = 'I' THEN '' ELSE f.text END AS text, first_value(r.x = 'K' AND f.initial = 's') OVER (PARTITION BY r.conv ORDER BY r.place) AS opened
  FROM read r LEFT JOIN faults f ON r.x <> 'I' AND coalesce(f.conv_id, -9223372036854775808) = r.conv AND f.i = r.i WHERE r.x <> 'D'),
said AS (SELECT conv, string_agg(CASE WHEN x = 'K' THEN role WHEN (place - opened::BIGINT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS text FROM spoken GROUP BY conv),
sums AS (SELECT coalesce(conv_id, -9223372036854775808) AS conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::BIGINT) AS blank, sum(duplicate::BIGINT) AS duplicate, sum(truncated::BIGINT) AS truncated,
  sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT) AS illegal FROM faults GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(e.e.c, 0)::BIGINT AS cost, coalesce(e.e.a, '') AS audit, sha256(coalesce(d.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sums m ON m.conv = coalesce(o.conv_id, -9223372036854775808) LEFT JOIN ends e ON e.conv = m.conv LEFT JOIN said d ON d.conv = m.conv
"""


ORACLES = {"op2_mixing": _mixing_sql(), "op4_urls": _urls_sql(), "op5_licenses": _licenses_sql(), "op6_chat": _chat_sql(), "op10_decontam": _decontam_sql(), "op11_topk": _topk_sql(), "op13_repair": _repair_sql()}
