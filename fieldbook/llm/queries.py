"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm import fill_in_middle, fingerprints, jaccard_join, line_dedup, merkle, mixing, nearest, packing, quality_classifier, sharding, suffix_dedup, topk, url_filters
from fieldbook.llm.common import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(quality_classifier.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return sharding.shuffle_shards(table(spark, sf_dir, "documents"))


@query
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component among links of similarity 0.85 or more on four-word shingles."""
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


SQL["op3_ngram_jaccard_join"] = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
    ),
    sets AS (
        SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
    ),
    n AS (SELECT doc_id, len(s) AS n FROM sets),
    e AS (SELECT doc_id, unnest(s) AS x FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT a, r FROM reach JOIN both_ways ON b = d)
    SELECT doc_id, n AS n_shingles, min(r) AS component_id FROM n JOIN reach ON d = doc_id GROUP BY doc_id, n
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of 1024."""
    return packing.pack_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path())


#: Shares of sources, languages and topics go with this power of their tokens.
MIXING_POWER = 0.7
MIXING_BUDGET = 0.5
#: Rounds after which the SQL's raking has converged.
MIXING_ROUNDS = 40


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance in a mix with raked shares of sources, languages and topics, and whether it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.tokens_of(F.col("text")).alias("words"))
    docs = mixing.with_topic(docs, table(spark, sf_dir, "embeddings"))
    mixed = mixing.mix(docs, {n: F.col(n) for n in ("source", "lang", "topic")}, power=MIXING_POWER, budget=MIXING_BUDGET, tokens=F.col("words"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


SQL["op5_mixing"] = f"""
    WITH topics AS (SELECT vec_id, min(label)::VARCHAR AS topic FROM embeddings WHERE label IS NOT NULL GROUP BY vec_id),
    counted AS (
        SELECT doc_id, source, lang, topic, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, coalesce(topic, '(none)') AS p,
               coalesce(len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')), 0)::BIGINT AS tokens
        FROM documents LEFT JOIN topics ON doc_id = vec_id
    ),
    cells AS (SELECT s, l, p, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY s, l, p),
    {mixing.raking_sql(["s", "l", "p"], MIXING_POWER, MIXING_ROUNDS, MIXING_BUDGET)},
    chances AS (
        SELECT d.*, CASE WHEN r.tokens > 0 THEN least(1.0::DOUBLE, r.budget * r.weight / r.tokens) ELSE 1.0::DOUBLE END AS chance,
               ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u
        FROM counted d JOIN raked r ON d.s = r.s AND d.l = r.l AND d.p = r.p
    )
    SELECT doc_id, source, lang, topic, tokens, round(chance, 6) AS probability, u < chance AS sampled FROM chances
"""


#: Written rules: host/path and verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by written rules, else by rules mined from labelled pages."""
    judged = url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op6_url_filters"] = f"""
    WITH RECURSIVE parsed AS (
        SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(.*)$', 1), '') AS rest FROM pages
    ),
    urls AS (
        SELECT DISTINCT url, list_distinct(list_concat(
            list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
            list_transform(list_filter(string_split_regex(translate(path, {_AZ}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'p:' || x),
            list_transform(list_filter(string_split_regex(translate(rest, {_AZ}), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'q:' || x))) AS own
        FROM parsed WHERE url IS NOT NULL
    ),
    bad AS (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    known AS (SELECT page_id, url, own, bad FROM (SELECT DISTINCT page_id, url FROM pages) JOIN bad ON page_id = doc_id JOIN urls USING (url) WHERE len(own) > 0 OR bad),
    least AS (SELECT least(count(*), {url_filters.MIN_PAGES}) AS n FROM known),
    each AS (SELECT page_id, url, bad, unnest(own) AS token FROM known),
    tokens AS (SELECT token, count(*) AS freq, count(*) FILTER (bad) AS n_bad, md5(string_agg(page_id || ' ' || url, chr(10) ORDER BY page_id, url)) AS held_by FROM each GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT n FROM least)),
    items AS (SELECT *, min(token) OVER (PARTITION BY held_by) AS tok FROM tokens),
    single AS (SELECT tok, n_bad >= {url_filters.MIN_CONFIDENCE} * freq AS sure FROM items WHERE token = tok),
    unsure AS (SELECT e.page_id, e.url, e.bad, tok FROM each e JOIN single ON token = tok WHERE NOT sure),
    sets AS (
        SELECT page_id, url, bad, [tok] AS toks FROM unsure
        UNION ALL SELECT s.page_id, s.url, s.bad, list_append(s.toks, u.tok) FROM sets s JOIN unsure u ON s.page_id = u.page_id AND s.url = u.url AND s.toks[-1] < u.tok
    ),
    mined AS (
        SELECT [tok] AS toks FROM single WHERE sure
        UNION ALL SELECT toks FROM sets WHERE len(toks) > 1 GROUP BY toks HAVING count(*) FILTER (bad) >= (SELECT n FROM least) AND count(*) FILTER (bad) >= {url_filters.MIN_CONFIDENCE} * count(*)
    ),
    holding AS (SELECT url, list(DISTINCT tok) AS toks FROM (SELECT url, unnest(own) AS token FROM urls) JOIN items USING (token) GROUP BY url),
    blocked AS (SELECT DISTINCT url FROM holding h JOIN mined m ON list_has_all(h.toks, m.toks)),
    rules AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in URL_RULES)}) v(rule, rule_host, rule_path, rule_verdict)),
    fitting AS (
        SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
        FROM (SELECT DISTINCT url, host, path FROM parsed) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url
    )
    SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN b.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
    FROM parsed p LEFT JOIN fitting f ON p.url = f.url LEFT JOIN blocked b ON p.url = b.url
"""


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to line runs that occur earlier."""
    out = line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.size("spans").cast("long").alias("n_spans"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


SQL["op7_line_dedup"] = """
    WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line, trim(ls[i], ' ') AS norm FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
    runs AS (
        SELECT doc_id, pos, 1 AS n, norm AS content FROM l WHERE length(norm) - length(replace(norm, ' ', '')) + 1 >= 50
        UNION ALL
        SELECT a.doc_id, a.pos, 2 AS n, a.norm || chr(10) || b.norm AS content FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
    ),
    later AS (SELECT doc_id, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY n, content ORDER BY doc_id, pos) AS k FROM runs) WHERE k > 1),
    gone AS (SELECT DISTINCT doc_id, pos + unnest(range(0, n)) AS pos FROM later),
    marked AS (SELECT l.*, gone.pos IS NOT NULL AS gone FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos),
    edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM marked)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans,
           md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
    FROM edges GROUP BY doc_id
"""


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    docs = table(spark, sf_dir, "documents")
    return fingerprints.compare_edited(docs, fingerprints.rarity(spread(docs.select("text"))))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that start elsewhere too."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept_text")


SQL["op9_suffix_dedup"] = """
    WITH h AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
    s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 399))) AS i FROM h)),
    r AS (SELECT doc_id, i FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
    g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS begins FROM r),
    k AS (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
    gone AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY doc_id, span),
    stays AS (
        SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM gone
        UNION ALL SELECT h.doc_id, coalesce(max(b), 0), length(x) // 2 FROM h LEFT JOIN gone ON h.doc_id = gone.doc_id GROUP BY h.doc_id, x
    ),
    parts AS (SELECT h.doc_id, x, a, substr(x, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT) AS y FROM stays JOIN h ON h.doc_id = stays.doc_id),
    kept AS (
        SELECT doc_id, x, string_agg(y, '' ORDER BY a) AS y,
               string_agg(regexp_extract(y, '^(?:[89AB].)*((?:[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)*)', 1), '' ORDER BY a) AS z
        FROM parts GROUP BY doc_id, x
    )
    SELECT kept.doc_id, length(x) // 2 AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans, sha256(unhex(y)) AS kept_sha256, decode(unhex(z)) AS kept_text
    FROM kept LEFT JOIN gone ON kept.doc_id = gone.doc_id GROUP BY kept.doc_id, x, y, z
"""


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for each fiftieth vec_id."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, the roots over it, and whether its row, of which every other one lost its line ends, still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(docs, {"now": merkle.leaf(*[text if c == "text" else F.col(c) for c in merkle.COLUMNS])})
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("now"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, nodes: str) -> str:
    """Common table expressions: all levels over nodes (tree, pos, digest) as {name}, their tops as {name}_top, and siblings (tree, level, pos, before, after) as {name}_side."""
    return f"""
    {name} AS (
        SELECT tree, 0 AS level, pos, digest, count(*) OVER (PARTITION BY tree) AS n FROM {nodes}
        UNION ALL
        SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3, n
    ),
    {name}_top AS (SELECT tree, digest AS top FROM {name} WHERE n = 1),
    {name}_side AS (
        SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
        FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos
    )"""


_ENCODED = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))

SQL["op11_merkle_manifest"] = f"""
    WITH RECURSIVE crc AS (
        SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, c:
            list_reduce(list_prepend(xor(x, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)) AS inverted
        FROM documents
    ),
    leaves AS (
        SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, sha256({_ENCODED} || coalesce(strlen(text) || ':' || text, '-')) AS digest,
               CASE WHEN inverted & 1 = 1 THEN sha256({_ENCODED} || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS now
        FROM documents JOIN crc USING (doc_id)
    ),
    sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
    placed AS (SELECT l.*, s.tree FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
    {_tree_sql("t", "placed")},
    tops AS (SELECT 0 AS tree, tree AS pos, top AS digest FROM t_top),
    {_tree_sql("u", "tops")},
    steps AS (
        SELECT p.doc_id, 0 AS half, level, before, after FROM placed p JOIN t_side s ON s.tree = p.tree AND s.pos = p.pos // (3 ** level)::BIGINT
        UNION ALL SELECT p.doc_id, 1, level, before, after FROM placed p JOIN u_side s ON s.pos = p.tree // (3 ** level)::BIGINT
    ),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY half, level) AS k FROM steps),
    fold AS (
        SELECT doc_id, 0::BIGINT AS k, coalesce(now, digest) AS own FROM placed
        UNION ALL SELECT f.doc_id, n.k, sha256(n.before || own || n.after) FROM fold f JOIN numbered n ON n.doc_id = f.doc_id AND n.k = f.k + 1
    ),
    folded AS (SELECT doc_id, arg_max(own, k) AS folded_root FROM fold GROUP BY doc_id),
    proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM numbered GROUP BY doc_id)
    SELECT p.doc_id, p.digest AS leaf, t_top.top AS subroot, u_top.top AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = u_top.top AS verified
    FROM placed p JOIN t_top ON t_top.tree = p.tree CROSS JOIN u_top JOIN folded f ON f.doc_id = p.doc_id LEFT JOIN proofs r ON r.doc_id = p.doc_id
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's arrangement, and the text that is read back from it."""
    out = fill_in_middle.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL["op12_fill_in_middle"] = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
    x AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
    c AS (
        SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
               CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
    ),
    p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
"""


@query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty highest inner products of each twentieth vec_id."""
    return topk.top(table(spark, sf_dir, "embeddings"), every=20, k=20)


SQL["op13_exact_top_k"] = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
