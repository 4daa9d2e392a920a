"""The registered queries over the reference tables, each with SQL for its rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import html as H
from quarry.operators import markdown as M
from quarry.operators import retrieval as R
from quarry.operators import split as S
from quarry.plans import derived as _derived  # noqa: F401  registers its queries
from quarry.plans import sql as Q
from quarry.plans.registry import QUERIES, SQL, query
from quarry.schema import TITLE_SEPARATOR
from quarry.sources import files, rest

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page_content"))


CHUNKS_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM documents),
m AS (
  SELECT doc_id, a, 1 AS i, 1 AS s, length(a[1]) AS n FROM l WHERE len(a) > 0
  UNION ALL
  SELECT doc_id, a, i + 1, CASE WHEN n + 1 + length(a[i + 1]) > {size} THEN i + 1 ELSE s END,
    CASE WHEN n + 1 + length(a[i + 1]) > {size} THEN length(a[i + 1]) ELSE n + 1 + length(a[i + 1]) END
  FROM m WHERE i < len(a)),
c AS (SELECT doc_id, s, regexp_replace(array_to_string(any_value(a)[s:max(i)], chr(10)), '^\\s+|\\s+$', '', 'g') AS chunk FROM m GROUP BY doc_id, s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS ord, {chunk} AS page_content FROM c{join} WHERE chunk <> ''
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to chunks of lines with their titles in front."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.array("source", "lang").alias("titles"), F.col("text").alias("page_content"))
    return S.split_by_character(docs, "\n", S.SplitConfig(1000, 0), titles="titles").select("doc_id", "ord", "page_content")


@query(CHUNKS_SQL.format(size=1000, chunk=f"source || chr(10) || lang || chr(10) || '{TITLE_SEPARATOR}' || chr(10) || chunk", join=" JOIN documents USING (doc_id)"))
def chunk_title_prefix(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(CHUNKS_SQL.format(size=1000, chunk="chunk", join=""))
def char_chunks_overlap0(spark, sf_dir):
    return S.split_by_character(_docs(spark, sf_dir), "\n", S.SplitConfig(1000, 0))


OVERLAP_SQL = """
WITH RECURSIVE l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM documents),
q AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM l),
p AS (SELECT doc_id, list(n ORDER BY i) AS p FROM (SELECT doc_id, i, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM q) GROUP BY doc_id),
-- a chunk is parts s to e; its length is p[e] - p[s - 1] - 1
m AS (
  SELECT doc_id, a, p, 1 AS k, 1 AS s, greatest(1, len(list_filter(p, lambda n: n - 1 <= {size}))) AS e FROM l JOIN p USING (doc_id)
  UNION ALL
  SELECT doc_id, a, p, k + 1, t, greatest(t, len(list_filter(p, lambda n: n - CASE WHEN t = 1 THEN 0 ELSE p[t - 1] END - 1 <= {size})))
  FROM (SELECT doc_id, a, p, k, e, greatest(s, least(e + 1, CASE WHEN x <= 0 THEN 1 ELSE len(list_filter(p, lambda n: n < x)) + 2 END)) AS t
        FROM (SELECT *, p[e] - 1 - least({overlap}, {size} - length(a[e + 1]) - 1) AS x FROM m WHERE e < len(a)))),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, chunk FROM (SELECT doc_id, k, regexp_replace(array_to_string(a[s:e], chr(10)), '^\\s+|\\s+$', '', 'g') AS chunk FROM m) WHERE chunk <> ''),
f AS (
  SELECT doc_id, ord, chunk, strpos(text, chunk) - 1 AS start_index FROM c JOIN l USING (doc_id) WHERE ord = 0
  UNION ALL
  SELECT doc_id, c.ord, c.chunk, CASE WHEN strpos(substr(text, start_index + 2), c.chunk) > 0 THEN start_index + strpos(substr(text, start_index + 2), c.chunk) ELSE -1 END
  FROM f JOIN l USING (doc_id) JOIN c USING (doc_id) WHERE c.ord = f.ord + 1)
SELECT doc_id, ord, start_index, chunk AS page_content FROM f
"""


@query(OVERLAP_SQL.format(size=1000, overlap=200))
def char_chunks_overlap200(spark, sf_dir):
    return S.split_by_character(_docs(spark, sf_dir), "\n", S.SplitConfig(1000, 200, add_start_index=True))


@query()
def recursive_chunks(spark, sf_dir):
    return S.split_recursively(_docs(spark, sf_dir), cfg=S.SplitConfig(500, 50, keep_separator=True))


@query("SELECT doc_id, ord, part FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS part FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS a FROM documents))")
def split_lines_drop_sep(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.split_parts(F.col("page_content"), "\n", False)).alias("ord", "part"))


@query("SELECT doc_id, generate_subscripts(b, 1) - 1 AS ord, unnest(b) AS part FROM (SELECT doc_id, list_filter(list_transform(a, lambda x, i: CASE WHEN i > 1 THEN chr(10) ELSE '' END || x), lambda x: x <> '') AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))")
def split_lines_keep_sep(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.split_parts(F.col("page_content"), "\n", True)).alias("ord", "part"))


@query("SELECT doc_id, (s / 350)::INT AS ord, substr(text, s + 1, 400) AS page_content FROM (SELECT doc_id, text, unnest(range(0, length(text), 350)) AS s FROM documents)")
def token_windows_char(spark, sf_dir):
    return S.split_characters(_docs(spark, sf_dir), 400, 50)


@query("""SELECT doc_id, source AS h1, lang AS h2, string_agg(trim(x), chr(10) ORDER BY i) AS page_content FROM (SELECT doc_id, source, lang, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(x) <> '' GROUP BY ALL""")
def md_header_split(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text").alias("page_content"))
    return S.split_markdown_headers(docs, [("#", "h1"), ("##", "h2")]).select("doc_id", F.col("headers")["h1"].alias("h1"), F.col("headers")["h2"].alias("h2"), "page_content")


_LINKED = "'[' || source || '](http://' || lang || ') ![[' || source || ']] ' || text"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({_LINKED}, '!\\[\\[(.*)\\]\\]', '', 'g'), '\\[(.*?)\\]\\((.*?)\\)', '\\1', 'g') AS plain FROM documents")
def md_strip_links_images(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    marked = F.concat(F.lit("["), "source", F.lit("](http://"), "lang", F.lit(") ![["), "source", F.lit("]] "), "text")
    return d.select("doc_id", X.strip_links(X.strip_wiki_images(marked)).alias("plain"))


_PLAIN = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_TITLE = "coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), ''), '[no-title]')"


def _page_title(spark, sf_dir, **cfg):
    return _t(spark, sf_dir, "pages").select("page_id", H.page_udf(H.HtmlConfig(use_summary=False, **cfg))("html", F.lit(None).cast("string"))["title"].alias("title"))


@query(f"SELECT page_id, {_PLAIN.format(_TITLE)} AS title FROM pages")
def html_title(spark, sf_dir):
    return _page_title(spark, sf_dir)


@query(f"SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h[12][ >]') THEN {_PLAIN.format("trim(regexp_replace(regexp_extract(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), '<[^>]*>', '', 'g'))")} ELSE {_PLAIN.format(_TITLE)} END AS title FROM pages")
def html_first_header(spark, sf_dir):
    return _page_title(spark, sf_dir, use_first_header_as_title=True)


@query("SELECT n_nationkey, n_nationkey::VARCHAR AS k, 'n_nationkey为' || n_nationkey || '的n_name是' || n_name || chr(10) || chr(10) || 'n_nationkey为' || n_nationkey || '的region是' || r_name AS sentence FROM nation JOIN region ON n_regionkey = r_regionkey")
def table_rows_to_sentences(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    header = F.array(F.lit("n_nationkey"), F.lit("n_name"), F.lit("region"))
    key = F.col("n_nationkey").cast("string")
    return n.select("n_nationkey", key.alias("k"), X.row_sentence(header, F.array(key, "n_name", "r_name")).alias("sentence"))


@query("SELECT r_regionkey, '| key | key name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || r_regionkey || ' | ' || r_name || ' |' AS table_md FROM region")
def table_markdown(spark, sf_dir):
    cells = F.array(F.array(F.lit("key"), F.lit("key")), F.array(F.lit("key"), F.lit("name")), F.array(F.col("r_regionkey").cast("string"), "r_name"))
    return _t(spark, sf_dir, "region").select("r_regionkey", X.table_markdown(X.merged_header(cells)).alias("table_md"))


@query("SELECT conv_id, turn, a || substr(b, coalesce(list_min(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) + 1) AS joined FROM (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
def splice_pairs(spark, sf_dir):
    from pyspark.sql import Window as W

    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return c.filter("b IS NOT NULL").select("conv_id", "turn", X.splice(F.col("a"), F.col("b")).alias("joined"))


#: Hits 1, 2, 3 and more turns apart.
_VARIED = "(conv_id * 31 + turn * turn * 17 + turn * 3) % 7 < 3"


def _segments(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    seg = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("doc_id"), F.col("turn").alias("position"), F.concat("text", F.lit("\n")).alias("page_content"))
    hits = c.filter(_VARIED).select(F.col("conv_id").alias("document_id"), F.col("turn").alias("doc_id"), F.col("turn").alias("hit_ord"))
    return hits, seg


@query(f"""WITH h AS (SELECT conv_id, turn FROM conversations WHERE {_VARIED}), g AS (SELECT conv_id, turn, CASE WHEN turn - lag(turn) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM g), b AS (SELECT conv_id, k, min(turn) AS first, max(turn) AS last FROM i GROUP BY ALL)
SELECT conv_id AS document_id, first AS seed_ord, first AS seed_doc_id, first, last, string_agg(text || chr(10), '' ORDER BY turn) AS page_content FROM b JOIN conversations USING (conv_id) WHERE turn BETWEEN first AND last GROUP BY conv_id, first, last""")
def normal_islands(spark, sf_dir):
    return R.positional_islands(*_segments(spark, sf_dir))


@query(f"""WITH h AS (SELECT conv_id, turn, role FROM conversations WHERE {_VARIED}), b AS (SELECT conv_id, role, string_agg(text, '' ORDER BY turn, text) AS page_content FROM conversations GROUP BY ALL)
SELECT conv_id AS document_id, page_content, min(turn) AS hit_ord FROM h JOIN b USING (conv_id, role) GROUP BY ALL""")
def title_expand(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    seg = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), F.col("role").alias("title"), F.col("text").alias("content"))
    hits = c.filter(_VARIED).select(F.col("conv_id").alias("document_id"), F.col("turn").alias("hit_ord"), F.col("role").alias("title"))
    return R.title_expansion(hits, seg)


@query(f"SELECT conv_id AS document_id, CASE WHEN arg_min(role, turn) = 'system' THEN 'title' ELSE 'position' END AS strategy, min(turn) AS first_ord FROM conversations GROUP BY 1")
def strategy_dispatch(spark, sf_dir):
    hits = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("hit_ord"), F.when(F.col("role") == "system", F.concat(F.lit(TITLE_SEPARATOR), "text")).otherwise(F.col("text")).alias("page_content"))
    return R.dispatch(hits)


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_content(spark, sf_dir):
    return R.distinct_contents(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) > 0 AS non_blank, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def whitespace(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.non_blank(F.col("text")).alias("non_blank"), X.collapse(F.col("text")).alias("collapsed"))


@query("""SELECT doc_id, 'POST' AS method, '/v1/datasets/set/document/create_by_text' AS path,
  '{"name":"' || doc_id || '","indexing_technique":"high_quality","process_rule":{"mode":"automatic","rules":null},"text":' || coalesce(to_json(text)::VARCHAR, 'null') || '}' AS body FROM documents""")
def rest_payload(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", rest.create_by_text(F.lit("set"), F.col("doc_id").cast("string"), F.col("text")).alias("q")).select("doc_id", "q.method", "q.path", "q.body")


# Extraction. Recovery from broken markup and the choice of the main content are no SQL.


def _flat(df):
    return df.withColumn("titles", F.array_join("titles", " > "))


@query()
def html_documents(spark, sf_dir):
    return _flat(H.extract_html(_t(spark, sf_dir, "pages")))


@query()
def html_documents_whole(spark, sf_dir):
    return _flat(H.extract_html(_t(spark, sf_dir, "pages"), H.HtmlConfig(use_summary=False, title_convert_to_markdown=True, contain_closest_title_levels=2)))


_ROWS = "SELECT n_nationkey, title, row::INT AS row, 'k为' || n_nationkey || '的' || c || '是' || v AS page_content FROM (SELECT n_nationkey, r_name AS title, 0 AS row, 'n' AS c, n_name AS v FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(_ROWS)
def html_table_rows(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    html = F.concat(F.lit("<title>"), "r_name", F.lit("</title><table><tr><th>k<th>n<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("<td>"), "n_name", F.lit("</table>"))
    docs = H.extract_html(n.select("n_nationkey", html.alias("html"))).filter("content_type = 'table'")
    return docs.select("n_nationkey", F.element_at("titles", 1).alias("title"), "row", "page_content")


@query("SELECT doc_id, 0 AS ord, '# ' || source || ' > ## ' || lang AS titles, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS page_content FROM documents WHERE regexp_matches(text, '\\S')")
def markdown_documents(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), "text").alias("page_content"))
    return _flat(M.extract_markdown(docs)).drop("content_type")


_COMMON = X.COMMON.replace("'", "''")


@query(f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS x FROM documents WHERE text <> ''), b AS (SELECT doc_id, x, (NOT (contains('{_COMMON}', x) OR x BETWEEN '一' AND '龥'))::INT AS bad FROM c),
r AS (SELECT doc_id, bad, row_number() OVER w AS seen, sum(bad) OVER (PARTITION BY doc_id ORDER BY x ROWS UNBOUNDED PRECEDING) AS n FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY x ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(ok, false) END AS readable FROM documents LEFT JOIN (SELECT doc_id, bool_and(bad = 0 OR n <= 0.3::DOUBLE * seen) AND sum(bad) < 0.3::DOUBLE * count(*) AS ok FROM r GROUP BY 1) USING (doc_id)""")
def readable_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", X.is_readable(F.col("text")).alias("readable"))


_BUDGET = 2000


@query(f"""WITH RECURSIVE h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE {_VARIED}),
n AS (SELECT conv_id, turn, length(text) + 1 AS n, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations),
s AS (SELECT h.conv_id, h.k, h.turn, n.upto, n.upto - n.n AS before FROM h JOIN n USING (conv_id, turn)),
g AS (
  SELECT conv_id, k, turn, turn AS first, before FROM s WHERE k = 1
  UNION ALL
  SELECT s.conv_id, s.k, s.turn, CASE WHEN s.turn - g.turn <= 2 AND s.upto - g.before <= {_BUDGET} THEN g.first ELSE s.turn END, CASE WHEN s.turn - g.turn <= 2 AND s.upto - g.before <= {_BUDGET} THEN g.before ELSE s.before END
  FROM g JOIN s ON s.conv_id = g.conv_id AND s.k = g.k + 1),
b AS (SELECT conv_id, first, max(turn) AS last FROM g GROUP BY conv_id, first)
SELECT conv_id AS document_id, first AS hit_ord, string_agg(text || chr(10), '' ORDER BY turn) AS page_content FROM b JOIN conversations USING (conv_id) WHERE turn BETWEEN first AND last GROUP BY conv_id, first""")
def normal_growth(spark, sf_dir):
    return R.positional_growth(*_segments(spark, sf_dir))


def _spliced(a: str, b: str) -> str:
    """SQL of two texts joined over their shortest overlap."""
    return f"({a} || substr({b}, coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda k: right({a}, k) = left({b}, k))), 0) + 1))"


@query(f"""WITH RECURSIVE s AS (SELECT conv_id, role, text, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS i, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations),
h AS (SELECT conv_id, turn, role, text, (SELECT min(i) FROM s WHERE s.conv_id = c.conv_id AND s.role = c.role AND s.text = c.text) AS i FROM conversations c WHERE {_VARIED}),
g AS (
  SELECT conv_id, turn, role, i, 0 AS d, text FROM h
  UNION ALL
  SELECT conv_id, turn, role, i, d, {_spliced("coalesce(before, '')", "t")} FROM (
    SELECT g.conv_id, g.turn, g.role, g.i, g.d + 1 AS d, b.text AS before, {_spliced("g.text", "coalesce(a.text, '')")} AS t
    FROM g LEFT JOIN s a ON a.conv_id = g.conv_id AND a.role = g.role AND a.i = g.i + g.d + 1 LEFT JOIN s b ON b.conv_id = g.conv_id AND b.role = g.role AND b.i = g.i - g.d - 1
    WHERE length(g.text) < {_BUDGET} AND (a.i IS NOT NULL OR b.i IS NOT NULL))),
last AS (SELECT conv_id, turn, arg_max(text, d) AS page_content FROM g GROUP BY conv_id, turn)
SELECT conv_id AS document_id, min(turn) AS hit_ord, page_content FROM last GROUP BY conv_id, page_content""")
def title_growth(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    seg = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), F.col("role").alias("title"), F.col("text").alias("content"))
    hits = c.filter(_VARIED).select(F.col("conv_id").alias("document_id"), F.col("turn").alias("hit_ord"), F.col("role").alias("title"), F.col("text").alias("content"))
    return R.title_growth(hits, seg)


@query("SELECT page_id, 'utf-8' AS codec FROM pages")
def codec_sniff(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", files.codec(F.encode("html", "UTF-8")).alias("codec"))


@query("SELECT '/' || r_regionkey || '.csv' AS path, 0 AS ord, 'key为' || r_regionkey || '的name是' || r_name AS page_content FROM region")
def csv_documents(spark, sf_dir):
    r = _t(spark, sf_dir, "region")
    key = F.col("r_regionkey").cast("string")
    rows = r.select(F.concat(F.lit("/"), key, F.lit(".csv")).alias("path"), F.encode(F.concat(F.lit("key,name\n"), key, F.lit(","), "r_name", F.lit("\n")), "UTF-8").alias("content"))
    return files.extract_files(rows).select("path", "ord", "page_content")


@query()
def sql_chunks(spark, sf_dir):
    Q.register(spark)
    return spark.sql("SELECT doc_id, c.ord, c.page_content FROM {d} d, LATERAL recursive_chunks(d.text, 500, 50) c", d=_t(spark, sf_dir, "documents"))
