"""Text, parsing and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark import tables as T
from seamark.functions import text as X
from seamark.plans.registry import query

_LOWER = "lower(translate({c}, '" + X.ACCENTED + "', '" + X.BARE + "'))"


def _company_sql(c: str) -> str:
    out = _LOWER.format(c=c)
    for pattern in (X.LEGAL_FORMS, r"[^a-z0-9\s]", r"\s+"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim({out})"


@query(f"""
    SELECT s_suppkey, {_company_sql("n")} AS company, regexp_replace(upper(n), '[^A-Z0-9 ]', '', 'g') AS vessel, substr(sha256(n || '|' || s_nationkey::VARCHAR), 1, 24) AS id
    FROM (SELECT *, replace(s_name, '#', ' Éclair & Cö. ') || CASE s_suppkey % 3 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' Holdings PLC' ELSE ' GmbH' END AS n FROM supplier)""")
def normal_names(spark, d):
    """Normal forms of company and vessel names and a stable id."""
    form = F.when(F.col("s_suppkey") % 3 == 0, " Ltd.").when(F.col("s_suppkey") % 3 == 1, " Holdings PLC").otherwise(" GmbH")
    s = T.load(spark, d, "supplier").withColumn("n", F.concat(F.replace("s_name", F.lit("#"), F.lit(" Éclair & Cö. ")), form))
    return s.select("s_suppkey", X.company_key(F.col("n")).alias("company"), X.vessel_key(F.col("n")).alias("vessel"), X.short_id(F.col("n"), F.col("s_nationkey").cast("string")).alias("id"))


@query(r"""
    SELECT doc_id, len(regexp_extract_all(text, '[0-9]{9}')) AS mmsi_like, len(regexp_extract_all(text, '(?i)\b(kilos?|kilograms?|kg|tons?)\b')) AS quantities, len(regexp_extract_all(text, '\$[0-9][0-9,.]*')) AS money,
           regexp_extract(text, '([0-9]{1,3}(\.[0-9]{1,3}){3})', 1) AS first_ip FROM documents""")
def entity_patterns(spark, d):
    t = F.col("text")
    return T.load(spark, d, "documents").select(
        "doc_id", F.regexp_count(t, F.lit("[0-9]{9}")).cast("long").alias("mmsi_like"), F.regexp_count(t, F.lit(r"(?i)\b(kilos?|kilograms?|kg|tons?)\b")).cast("long").alias("quantities"),
        F.regexp_count(t, F.lit(r"\$[0-9][0-9,.]*")).cast("long").alias("money"), F.regexp_extract(t, r"([0-9]{1,3}(\.[0-9]{1,3}){3})", 1).alias("first_ip"),
    )


@query(r"""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') THEN 'ssn' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email' END,
           CASE WHEN regexp_matches(text, '\(?[0-9]{3}\)?[-. ][0-9]{3}[-.][0-9]{4}') THEN 'phone' END, CASE WHEN regexp_matches(text, '\b[0-9]{13,16}\b') THEN 'card' END], lambda x: x IS NOT NULL), ',') AS found
    FROM documents""")
def submission_privacy(spark, d):
    """Kinds of personal data named in a submission."""
    rules = {"ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\(?[0-9]{3}\)?[-. ][0-9]{3}[-.][0-9]{4}", "card": r"\b[0-9]{13,16}\b"}
    return T.load(spark, d, "documents").select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(F.regexp_like("text", F.lit(p)), k) for k, p in rules.items()])), ",").alias("found"))


CLASSES = {"CONFLICT": ("the", "enthe"), "TRADE": ("tion", "ment", "ung"), "WEATHER": ("ble", "keit", "ción"), "MIGRATION": ("ou", "heit")}


def _class_sql(c: str) -> str:
    hits = [f"({' + '.join(f'''contains(lower({c}), '{w}')::INT''' for w in ws)})" for ws in CLASSES.values()]
    top = f"greatest({', '.join(hits)})"
    return f"CASE WHEN {top} = 0 THEN 'UNKNOWN' " + " ".join(f"WHEN {h} = {top} THEN '{k}'" for k, h in zip(CLASSES, hits, strict=True)) + " END"


@query(f"SELECT doc_id, {_class_sql('text')} AS class FROM documents")
def keyword_classes(spark, d):
    return T.load(spark, d, "documents").select("doc_id", X.keyword_class(F.col("text"), CLASSES).alias("class"))


@query(r"""
    WITH w AS (SELECT doc_id, regexp_split_to_array(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(13)), '\s+')[1:100] AS ws FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter(ws, lambda x: x IN ('el', 'la', 'de', 'que', 'y', 'en', 'los', 'del', 'las', 'un', 'por', 'con', 'una', 'su', 'para', 'es', 'al', 'lo', 'como'))) > 0.15 * len(ws) THEN 'es' ELSE 'en' END AS guess FROM w""")
def stopword_language(spark, d):
    """Spanish where more than 15 % of the first hundred tokens are its stop words."""
    stop = ["el", "la", "de", "que", "y", "en", "los", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "lo", "como"]
    ws = F.slice(F.split(F.regexp_replace(F.lower("text"), r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"\s+"), 1, 100)
    share = F.transform(F.array(ws), lambda a: F.size(F.filter(a, lambda w: w.isin(stop))) > 0.15 * F.size(a))[0]
    return T.load(spark, d, "documents").select("doc_id", F.when(share, "es").otherwise("en").alias("guess"))


@query(r"""
    WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text, chr(32)), '\s+') AS ws FROM documents),
    c AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws), 1), 462)) AS i FROM w)
    SELECT doc_id, (i // 462)::BIGINT AS chunk, len(ws[i + 1:i + 512])::BIGINT AS n_words, md5(array_to_string(ws[i + 1:i + 512], ' ')) AS md5 FROM c""")
def text_chunks(spark, d):
    """Chunks of 512 words with 50 in common."""
    c = T.load(spark, d, "documents").select("doc_id", F.posexplode(X.word_chunks(F.col("text"))).alias("chunk", "body"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size(F.split("body", " ")).cast("long").alias("n_words"), F.md5("body").alias("md5"))


@query(r"SELECT page_id, length(t) AS n_chars, md5(t) AS md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)")
def stripped_pages(spark, d):
    t = T.load(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("md5"))


@query(r"""
    WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]+')) AS line FROM documents),
    m AS (SELECT doc_id, regexp_extract(line, '^(.*?) (because|due to|des|que|the) (.*)$', 1) AS effect, regexp_extract(line, '^(.*?) (because|due to|des|que|the) (.*)$', 3) AS cause FROM s)
    SELECT doc_id, count(*) AS clauses, count(DISTINCT lower(left(effect, 50))) AS distinct_effects FROM m WHERE len(regexp_split_to_array(trim(effect), ' +')) >= 2 AND len(regexp_split_to_array(trim(cause), ' +')) >= 2 GROUP BY 1""")
def causal_clauses(spark, d):
    """Sentences parted by a connective, with two words or more on either side."""
    pattern = r"^(.*?) (because|due to|des|que|the) (.*)$"
    line = F.explode(F.split("text", r"[.\n]+")).alias("line")
    m = T.load(spark, d, "documents").select("doc_id", line).select("doc_id", F.regexp_extract("line", pattern, 1).alias("effect"), F.regexp_extract("line", pattern, 3).alias("cause"))
    m = m.where((F.size(F.split(F.trim("effect"), " +")) >= 2) & (F.size(F.split(F.trim("cause"), " +")) >= 2))
    return m.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.countDistinct(F.lower(F.left("effect", F.lit(50)))).alias("distinct_effects"))


@query("""
    WITH a AS (SELECT p_partkey, p_name, lower(p_name) AS n FROM part), g AS (SELECT p_partkey, n, list_distinct([substr(n, i, 3) FOR i IN range(1, length(n) - 1)]) AS t FROM a),
    u AS (SELECT n, t FROM g GROUP BY ALL)
    SELECT x.n AS a, y.n AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE, 4) AS similarity FROM u x JOIN u y ON x.n < y.n WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE >= 0.3""")
def trigram_pairs(spark, d):
    """Names whose trigrams overlap by 0.3 or more: names meet on trigrams, each pair is measured once."""
    u = T.load(spark, d, "part").select(F.lower("p_name").alias("n")).distinct().withColumn("t", X.trigrams(F.col("n")))
    post = u.select("n", F.size("t").alias("k"), F.explode("t").alias("g"))
    other = post.select(F.col("n").alias("b"), F.col("k").alias("kb"), "g")
    pairs = post.join(other, "g").where("n < b").groupBy(F.col("n").alias("a"), "b", "k", "kb").agg(F.count("*").alias("c"))
    sim = F.col("c") / (F.col("k") + F.col("kb") - F.col("c"))
    return pairs.where(sim >= 0.3).select("a", "b", F.round(sim, 4).alias("similarity"))


@query("""
    SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN (props->>'k')::BIGINT < 20 THEN 'VERY_LOW' WHEN (props->>'k')::BIGINT < 40 THEN 'LOW' WHEN (props->>'k')::BIGINT < 60 THEN 'MODERATE' WHEN (props->>'k')::BIGINT < 80 THEN 'HIGH' ELSE 'VERY_HIGH' END AS label FROM events""")
def json_properties(spark, d):
    k = F.from_json("props", "k long")["k"]
    return T.load(spark, d, "events").select("event_id", k.alias("k"), X.confidence_label(k / 100).alias("label"))


@query("""
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, list_cosine_similarity(embedding, q) AS sim, (vec_id % 10) / 10.0::DOUBLE AS importance FROM embeddings, q)
    SELECT vec_id, label, round(0.7 * sim + 0.3 * importance, 5) AS score FROM s ORDER BY 0.7 * sim + 0.3 * importance DESC, vec_id LIMIT 5""")
def memory_recall(spark, d, query_id=7, k=5):
    """The memories nearest to one vector, blended with their importance."""
    e = T.load(spark, d, "embeddings")
    q = e.where(F.col("vec_id") == query_id).select(F.col("embedding").alias("q"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)

    a, b = F.col("embedding"), F.col("q")
    s = e.crossJoin(F.broadcast(q.limit(1))).withColumn("score", 0.7 * dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)) + 0.3 * (F.col("vec_id") % 10) / 10.0)
    return s.orderBy(F.desc("score"), "vec_id").limit(k).select("vec_id", "label", F.round("score", 5).alias("score"))


GKG = "'4#' || p_name || '#' || p_brand || '#X' || p_size::VARCHAR || '#' || (p_size / 2.0)::VARCHAR || '#-' || p_partkey::VARCHAR || '#id;1#short;2#' || p_type || '#US#US01#1.5#2.5#f'"


@query(f"""
    WITH r AS (SELECT p_partkey, unnest(string_split({GKG}, ';')) AS loc FROM part), f AS (SELECT p_partkey, string_split(loc, '#') AS x FROM r)
    SELECT p_partkey, x[2] AS name, x[3] AS country, coalesce(try_cast(x[5] AS DOUBLE), 0) AS lat, coalesce(try_cast(x[6] AS DOUBLE), 0) AS lon FROM f WHERE len(x) >= 7""")
def nested_locations(spark, d):
    """Locations packed as ``#`` fields inside ``;`` lists; short ones are dropped, bad numbers are 0."""
    p = T.load(spark, d, "part")
    packed = F.concat(F.lit("4#"), "p_name", F.lit("#"), "p_brand", F.lit("#X"), F.col("p_size").cast("string"), F.lit("#"), (F.col("p_size") / 2.0).cast("string"), F.lit("#-"), F.col("p_partkey").cast("string"), F.lit("#id;1#short;2#"), "p_type", F.lit("#US#US01#1.5#2.5#f"))
    x = p.select("p_partkey", F.explode(F.filter(F.transform(F.split(packed, ";"), lambda s: F.split(s, "#")), lambda s: F.size(s) >= 7)).alias("x"))
    return x.select("p_partkey", F.col("x")[1].alias("name"), F.col("x")[2].alias("country"), F.coalesce(F.expr("try_cast(x[4] as double)"), F.lit(0.0)).alias("lat"), F.coalesce(F.expr("try_cast(x[5] as double)"), F.lit(0.0)).alias("lon"))


@query("""
    SELECT event_id, CASE WHEN contains(lower(msg), 'connection') THEN 'SOURCE_UNAVAILABLE' WHEN contains(lower(msg), 'validation') THEN 'SCHEMA_VALIDATION' WHEN contains(lower(msg), 'timeout') THEN 'TIMEOUT' ELSE 'UNKNOWN' END AS category,
           (contains(lower(msg), 'connection') OR (contains(lower(msg), 'timeout') AND NOT contains(lower(msg), 'validation'))) AND event_id % 5 < 3 AS retry
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ConnectionError: refused' WHEN 1 THEN 'ValidationError at field' WHEN 2 THEN 'Timeout of 30s' ELSE 'boom' END AS msg FROM events WHERE event_type = 'error')""")
def dead_letters(spark, d):
    """Error categories in order of precedence, and which letters go back with fewer than three tries."""
    i = F.col("event_id")
    msg = F.when(i % 4 == 0, "ConnectionError: refused").when(i % 4 == 1, "ValidationError at field").when(i % 4 == 2, "Timeout of 30s").otherwise("boom")
    e = T.load(spark, d, "events").where("event_type = 'error'").withColumn("m", F.lower(msg))
    category = F.when(F.contains("m", F.lit("connection")), "SOURCE_UNAVAILABLE").when(F.contains("m", F.lit("validation")), "SCHEMA_VALIDATION").when(F.contains("m", F.lit("timeout")), "TIMEOUT").otherwise("UNKNOWN")
    return e.withColumn("category", category).select("event_id", "category", (F.col("category").isin("SOURCE_UNAVAILABLE", "TIMEOUT") & (i % 5 < 3)).alias("retry"))


@query("""
    SELECT o_orderkey, list_min(list_concat(range(y, y + 3), [y + 5])) AS first_year, array_to_string(list_transform(list_concat(range(y, y + 3), [y + 5]), lambda x: x::VARCHAR), ',') AS years FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def year_ranges(spark, d):
    """Years written as ``2001-2003;2006``."""
    y = F.year("o_orderdate")
    o = T.load(spark, d, "orders").withColumn("raw", F.concat(y.cast("string"), F.lit("-"), (y + 2).cast("string"), F.lit(";"), (y + 5).cast("string")))
    years = F.flatten(F.transform(F.split("raw", ";"), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))))
    return o.withColumn("ys", years).select("o_orderkey", F.array_min("ys").cast("long").alias("first_year"), F.array_join(F.col("ys").cast("array<string>"), ",").alias("years"))


@query("""
    SELECT part.p_partkey, list_sum(list_transform(range(0, 4), lambda i: ((p_partkey * 7919) // (256 ** i)::BIGINT % 256) * (256 ** i)::BIGINT))::BIGINT AS number, (p_partkey % 256) // 16 AS high_nibble, (p_partkey % 16) AS low_nibble,
           round((p_partkey * 7919 % 65536) * 0.5 - 1000, 3) AS altitude FROM part""")
def frame_fields(spark, d):
    """Little-endian integers, nibbles and scaled fields of a packed frame."""
    n = F.col("p_partkey") * 7919
    # a frame holds the low four bytes
    frame = F.unhex(F.lpad(F.hex(n.bitwiseAND(0xFFFFFFFF)), 8, "0"))
    p = T.load(spark, d, "part").withColumn("frame", F.reverse(F.hex(frame)))
    # hex digits reversed: digit pairs are back to front and so are the bytes
    number = F.conv(F.reverse("frame"), 16, 10).cast("long")
    k = F.col("p_partkey")
    return p.select("p_partkey", number.alias("number"), F.shiftright(k.bitwiseAND(255), 4).cast("long").alias("high_nibble"), k.bitwiseAND(15).cast("long").alias("low_nibble"), F.round((n % 65536) * 0.5 - 1000, 3).alias("altitude"))


@query("""
    SELECT o_orderkey, round(least(1.0, 0.5 + CASE WHEN o_totalprice > 400000 THEN 0.2 WHEN o_totalprice > 200000 THEN 0.1 ELSE 0 END + CASE WHEN len(string_split(o_orderpriority, '-')) > 1 THEN 0.2 ELSE 0.1 END + 0.1 * (o_custkey % 2)), 4) AS confidence,
           round(least(10.0, o_custkey / 100.0 + o_totalprice / 100000), 2) AS severity FROM orders""")
def normalised_events(spark, d):
    """Source confidence and severity as the normalisers give them."""
    c = 0.5 + F.when(F.col("o_totalprice") > 400000, 0.2).when(F.col("o_totalprice") > 200000, 0.1).otherwise(0.0) + F.when(F.size(F.split("o_orderpriority", "-")) > 1, 0.2).otherwise(0.1) + 0.1 * (F.col("o_custkey") % 2)
    return T.load(spark, d, "orders").select("o_orderkey", F.round(F.least(F.lit(1.0), c), 4).alias("confidence"), F.round(F.least(F.lit(10.0), F.col("o_custkey") / 100.0 + F.col("o_totalprice") / 100000), 2).alias("severity"))
