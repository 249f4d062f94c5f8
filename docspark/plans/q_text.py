"""TXT and CHK: text functions and chunking over whole documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from docspark.functions import chunks as C
from docspark.functions import packing as P
from docspark.functions import text as X
from docspark.plans import tables as B
from docspark.plans.register import query

WS, HWS = X.WS, X.LINE_WS
CLEAN = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'),
  '{X.CONTROLS}', '', 'g'), ' {{2,}}', ' ', 'g'), '\\r\\n|[\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '(?m)^{HWS}+|{HWS}+$', '', 'g'), '\\A\\n+|\\n+\\z', '', 'g')"""
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')"


def docs(spark, sf):
    return B.read(spark, sf, "documents")


@query("txt1_clean_text", f"SELECT doc_id, {CLEAN} AS cleaned FROM documents")
def clean(spark, sf):
    return docs(spark, sf).select("doc_id", X.clean_text("text").alias("cleaned"))


@query(
    "txt2_txt5_counts",
    f"""SELECT doc_id, len({WORDS}) AS n_words, length(regexp_replace(coalesce(text, ''), '{WS}', '', 'g')) AS n_chars, length(coalesce(text, '')) AS raw_length,
        greatest(len({WORDS}), length(coalesce(text, '')) // 4) AS n_tokens FROM documents""",
)
def counts(spark, sf):
    return docs(spark, sf).select("doc_id", X.count_words("text").alias("n_words"), X.count_chars("text").alias("n_chars"), X.raw_length("text").alias("raw_length"), X.estimate_tokens("text").alias("n_tokens"))


STRIPPED = f"regexp_replace(x, '\\A{WS}+|{WS}+\\z', '', 'g')"


@query(
    "txt6_title_from_metadata",
    f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 7 = 0 THEN 'Given ' || lang END,
        list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIPPED}), lambda x: x <> '' AND length(x) < 100)[1], 'file' || doc_id) AS title FROM documents""",
)
def title_a(spark, sf):
    given = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Given "), F.col("lang")))
    return docs(spark, sf).select("doc_id", X.title_from_metadata(given, "text", F.concat(F.lit("dir/file"), F.col("doc_id"), F.lit(".txt"))).alias("title"))


@query(
    "txt7_title_from_lines",
    f"""SELECT doc_id, coalesce(list_filter(list_transform(list_slice(string_split(regexp_replace(coalesce(text, ''), '\\A{WS}+|{WS}+\\z', '', 'g'), chr(10)), 1, 5), lambda x: {STRIPPED}),
        lambda x: length(x) BETWEEN 3 AND 100 AND regexp_matches(x, '[\\p{{L}}\\p{{M}}\\p{{Nl}}\\p{{Pc}}\\x{{200c}}\\x{{200d}}]'))[1], 'document') AS title FROM documents""",
)
def title_b(spark, sf):
    return docs(spark, sf).select("doc_id", X.title_from_lines("text", F.lit("document.pdf")).alias("title"))


@query(
    "txt8_chat_title",
    f"""SELECT session_id, turn, CASE WHEN length(t) <= 30 THEN t WHEN p > 1 THEN substr(t, 1, p - 1) || '...' ELSE substr(t, 1, 30) || '...' END AS title
        FROM (SELECT session_id, turn, t, CASE WHEN instr(substr(t, 1, 31), ' ') > 0 THEN 32 - instr(reverse(substr(t, 1, 31)), ' ') ELSE 0 END AS p
              FROM (SELECT conv_id AS session_id, turn, regexp_replace(coalesce(text, ''), '\\A{WS}+|{WS}+\\z', '', 'g') AS t FROM conversations))""",
)
def chat_title(spark, sf):
    return B.messages(spark, sf).select("session_id", "turn", X.chat_title("content").alias("title"))


G = ", ".join(f"'{g}'" for g in X.GREETINGS)


@query(
    "txt9_greeting",
    f"""SELECT doc_id, list_contains([{G}], t) OR (strlen(t) < 8 AND len(list_filter([{G}], lambda g: starts_with(t, g || ' '))) > 0) AS greeting
        FROM (SELECT doc_id, lower(trim(CASE WHEN doc_id % 3 = 0 THEN 'Hi' WHEN doc_id % 3 = 1 THEN ' hey ' || substr(text, 1, 3) ELSE text END)) AS t FROM documents)""",
)
def greeting(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, "Hi").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" hey "), F.substring("text", 1, 3))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", X.is_greeting(t).alias("greeting"))


MIME_SQL = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.STORED_MIME.items()) + f" ELSE '{X.UNKNOWN_MIME}' END"


@query(
    "txt10_txt12_file_names",
    B.sql(
        f"""SELECT id, string_split(file_name, '.')[-1] AS file_type, {MIME_SQL} AS mime, stem, '.' || ext AS extension
            FROM (SELECT *, lower(string_split(file_name, '.')[-1]) AS ext, string_split(file_name, '.')[1] AS stem FROM registry)""",
        B.REGISTRY,
    ),
)
def file_names(spark, sf):
    n = F.col("file_name")
    return B.registry(spark, sf).select("id", X.file_type(n).alias("file_type"), X.mime_type(n).alias("mime"), X.file_stem(n).alias("stem"), X.file_extension(n).alias("extension"))


@query(
    "txt11_parsed_mime",
    B.sql("SELECT mime, count(*) AS n FROM (SELECT CASE lower(string_split(file_name, '.')[-1]) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.PARSED_MIME.items()) + f" ELSE '{X.UNKNOWN_MIME}' END AS mime FROM registry) GROUP BY mime", B.REGISTRY),
)
def parsed_mime(spark, sf):
    return B.registry(spark, sf).groupBy(X.mime_type(F.col("file_name"), X.PARSED_MIME).alias("mime")).agg(F.count("*").alias("n"))


@query("txt13_truncate", "SELECT doc_id, substr(text, 1, 8192) AS cut, length(substr(text, 1, 8192)) AS n FROM documents WHERE trim(coalesce(text, '')) <> ''")
def truncate(spark, sf):
    return docs(spark, sf).filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("doc_id", X.truncate("text").alias("cut"), X.raw_length(X.truncate("text")).alias("n"))


@query(
    "txt14_format_bytes",
    B.sql(
        """SELECT id, CASE WHEN file_size <= 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round(file_size / pow(1024, p), 2)), '0+$', ''), '\\.$', '') || ' ' || (['Bytes', 'KB', 'MB', 'GB'])[CAST(p AS INTEGER) + 1] END AS said
           FROM (SELECT id, file_size * 37 % 5000000 AS file_size, CASE WHEN file_size * 37 % 5000000 > 0 THEN least(floor(log2(file_size * 37 % 5000000) / 10), 3) ELSE 0 END AS p FROM registry)""",
        B.REGISTRY,
    ),
)
def format_bytes(spark, sf):
    return B.registry(spark, sf).select("id", X.format_bytes(F.col("file_size") * 37 % 5000000).alias("said"))


@query(
    "txt15_format_seconds",
    """SELECT event_id, CASE WHEN coalesce(s, 0) = 0 THEN '0s' WHEN s < 60 THEN CAST(CAST(CAST(s AS DECIMAL(18, 2)) AS DECIMAL(18, 1)) AS VARCHAR) || 's'
        WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ' || CAST(round(s % 60) AS BIGINT) || 's' ELSE CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor((s % 3600) / 60) AS BIGINT) || 'm' END AS said
       FROM (SELECT event_id, round(value * 97, 2) AS s FROM events)""",
)
def format_seconds(spark, sf):
    return B.read(spark, sf, "events").select("event_id", X.format_seconds(F.round(F.col("value") * 97, 2)).alias("said"))


@query("txt16_scope_key", "SELECT doc_id, 'qa:' || lang || ':' || source AS scope_key FROM documents")
def scope_key(spark, sf):
    return docs(spark, sf).select("doc_id", X.scope_key("qa", F.col("lang"), F.col("source")).alias("scope_key"))


@query(
    "txt22_token_usage",
    f"""SELECT doc_id, CAST(trunc(len({WORDS}) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS prompt_tokens, CAST(trunc(len({WORDS.replace("text", "lang")}) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS completion_tokens FROM documents""",
)
def token_usage(spark, sf):
    usage = X.token_usage(F.col("text"), F.col("lang"))
    return docs(spark, sf).select("doc_id", usage["prompt_tokens"].alias("prompt_tokens"), usage["completion_tokens"].alias("completion_tokens"))


@query(
    "txt23_roles",
    "SELECT conv_id, turn, CASE WHEN lower(r) IN ('system', 'user', 'assistant') THEN lower(r) ELSE 'user' END AS role FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN upper(role) WHEN 1 THEN 'tool' ELSE role END AS r, text FROM conversations) WHERE r IS NOT NULL AND text IS NOT NULL",
)
def roles(spark, sf):
    c = B.read(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.upper("role")).when(F.col("turn") % 3 == 1, "tool").otherwise(F.col("role"))
    return c.filter(said.isNotNull() & F.col("text").isNotNull()).select("conv_id", "turn", X.normalise_role(said).alias("role"))


def likeness_sql(lang: str) -> str:
    known = ", ".join(f"'{w}'" for w in X.STOP_WORDS[lang].split())
    return f"{X.WORD_WEIGHT} * len(list_filter(w, lambda x: list_contains([{known}], x))) + len(regexp_extract_all(low, '{X.PROFILES[lang]}')) AS {lang}"


@query(
    "txt24_guess_language",
    f"""SELECT doc_id, guess, guess = lang AS agrees FROM (
          SELECT doc_id, lang, CASE WHEN de > en AND de >= greatest(es, fr) THEN 'de' WHEN es > en AND es >= greatest(de, fr) THEN 'es' WHEN fr > en AND fr >= greatest(de, es) THEN 'fr' ELSE 'en' END AS guess
          FROM (SELECT doc_id, lang, {", ".join(map(likeness_sql, sorted(X.STOP_WORDS)))}
                FROM (SELECT doc_id, lang, low, regexp_split_to_array(low, '[^\\p{{L}}]+') AS w FROM (SELECT doc_id, lang, lower(substr(coalesce(text, ''), 1, 1000)) AS low FROM documents))))""",
)
def guess_language(spark, sf):
    return docs(spark, sf).select("doc_id", X.guess_language("text").alias("guess"), (X.guess_language("text") == F.col("lang")).alias("agrees"))


@query(
    "txt26_number_display",
    "SELECT event_id, CASE WHEN value IS NULL THEN '0' WHEN value = floor(value) THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', round(value, 2)) END AS said FROM events",
)
def number_display(spark, sf):
    return B.read(spark, sf, "events").select("event_id", X.number_display(F.col("value")).alias("said"))


@query(
    "chk2_token_chunks",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS index, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(1, ceil((len(w) - 20) / 80.0)) AS BIGINT))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)""",
)
def token_chunks(spark, sf):
    return C.token_chunks(docs(spark, sf).select("doc_id", "text"), 100, 20).select("doc_id", "index", "text")


def packed_sql(kind: str, text: str, size: int, overlap: int) -> str:
    """Chunks by recursion: parts level by level, then from each chunk's first part the next one's."""
    tokens = lambda words, chars: f"greatest({words}, ({chars}) // {P.TOKEN_CHARS})"
    n_words = f"len(list_filter(regexp_split_to_array(p, '{WS}+'), lambda x: x <> ''))"
    made, before = [f"level0 AS (SELECT doc_id, []::BIGINT[] AS place, regexp_replace(coalesce({text}, ''), '\\A{WS}+|{WS}+\\z', '', 'g') AS p FROM documents)"], "level0"
    for k, level in enumerate([*P.LEVELS[kind], "chars"]):
        if level == "chars":
            cut = f"list_transform(range(0, length(p), {size * P.TOKEN_CHARS}), lambda i: substr(p, CAST(i + 1 AS BIGINT), {size * P.TOKEN_CHARS}))"
        else:
            ends = P.ENDS[level].replace("\\s", WS).replace("\n", "\\n")
            cut = f"list_filter(regexp_extract_all(p, '(?s).*?(?:{ends}|\\z)'), lambda x: x <> '')"
        if k:
            cut = f"CASE WHEN {tokens(n_words, 'length(p)')} <= {size} THEN [p] ELSE {cut} END"
        made.append(f"level{k + 1} AS (SELECT doc_id, list_append(place, i) AS place, p FROM (SELECT doc_id, place, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, place, {cut} AS ps FROM {before})))")
        before = f"level{k + 1}"
    fits = lambda a, b, most: f"({tokens(f'pw[{b} + 1] - pw[{a}]', f'pc[{b} + 1] - pc[{a}]')} <= {most})"
    end = lambda a: f"greatest({a}, len(list_filter(range(1, n + 1), lambda j: {fits(a, 'j', size)})))"
    return f"""WITH RECURSIVE {", ".join(made)},
      parts AS (SELECT doc_id, place, p, sum({n_words}) OVER w AS w, sum(length(p)) OVER w AS c FROM {before} WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
      whole AS (SELECT doc_id, list(p ORDER BY place) AS ps, list_prepend(0, list(CAST(w AS BIGINT) ORDER BY place)) AS pw, list_prepend(0, list(CAST(c AS BIGINT) ORDER BY place)) AS pc, count(*) AS n FROM parts GROUP BY doc_id),
      chunk(doc_id, a, b) AS (
        SELECT doc_id, CAST(1 AS BIGINT), CAST({end("1")} AS BIGINT) FROM whole
        UNION ALL
        SELECT doc_id, CAST(k AS BIGINT), CAST({end("k")} AS BIGINT) FROM (
          SELECT whole.*, coalesce(list_min(list_filter(range(a + 1, b + 1), lambda k: {fits("k", "b", overlap)} AND {fits("k", "b + 1", size)})), b + 1) AS k FROM chunk JOIN whole USING (doc_id) WHERE b < n))
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS index, text FROM (
        SELECT doc_id, a, regexp_replace(array_to_string(ps[a:b], ''), '\\A{WS}+|{WS}+\\z', '', 'g') AS text FROM chunk JOIN whole USING (doc_id)) WHERE text <> ''"""


@query("chk3_sentence_chunks", packed_sql("sentence", "text", 100, 20))
def sentence_chunks(spark, sf):
    return C.sentence_chunks(docs(spark, sf).select("doc_id", "text"), 100, 20)


@query("chk4_paragraph_chunks", packed_sql("paragraph", "replace(text, chr(10), chr(10) || chr(10))", 100, 20))
def paragraph_chunks(spark, sf):
    return C.paragraph_chunks(docs(spark, sf).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text")), 100, 20)


@query("chk5_semantic_chunks")
def semantic_chunks(spark, sf):
    from docspark.operators.semantic import semantic_chunks as cut

    return cut(docs(spark, sf).select("doc_id", "text"))


def windows_sql(width: int, n: str) -> str:
    """The begins of overlapping windows over n tokens, 20 of them shared."""
    return f"range(0, CAST(greatest(1, ceil(({n} - 20) / {width - 20}.0)) AS BIGINT))"


@query(
    "chk6_hierarchical_chunks",
    f"""WITH given AS (SELECT doc_id, {WORDS} AS w FROM documents),
        l0 AS (SELECT doc_id, i AS index, NULL AS parent, i * 180 AS b, least(200, n - i * 180) AS n FROM (SELECT doc_id, len(w) AS n, unnest({windows_sql(200, "len(w)")}) AS i FROM given WHERE len(w) > 0)),
        l1 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY index, i) - 1 AS index, index AS parent, b + i * 80 AS b, least(100, n - i * 80) AS n FROM (SELECT *, unnest({windows_sql(100, "n")}) AS i FROM l0)),
        l2 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY index, i) - 1 AS index, index AS parent, b + i * 30 AS b, least(50, n - i * 30) AS n FROM (SELECT *, unnest({windows_sql(50, "n")}) AS i FROM l1))
        SELECT doc_id, level, CAST(index AS INTEGER) AS index, CAST(parent AS INTEGER) AS parent_index, CAST(b AS INTEGER) AS begin, CAST(b + n AS INTEGER) AS "end", array_to_string(w[b + 1 : b + n], ' ') AS text
        FROM (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2) JOIN given USING (doc_id)""",
)
def hierarchical_chunks(spark, sf):
    return C.hierarchical_chunks(docs(spark, sf), 200, 20)


@query(
    "chk7_statistics",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS index, length(text) AS chars, len({WORDS}) AS words, 'token' AS chunk_type FROM (
        SELECT doc_id, i, array_to_string(w[i * 80 + 1 : i * 80 + 100], ' ') AS text
        FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(1, ceil((len(w) - 20) / 80.0)) AS BIGINT))) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0))""",
)
def chunk_statistics(spark, sf):
    cut = C.token_chunks(docs(spark, sf).select("doc_id", "text"), 100, 20)
    return C.statistics(cut, "token").select("doc_id", "index", "chars", "words", "chunk_type")


@query(
    "chk8_for_embedding",
    f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS INTEGER) END, -1) AS index,
        CASE WHEN doc_id % 3 = 0 THEN 'given' ELSE CAST(length(regexp_replace(coalesce(text, ''), '{WS}', '', 'g')) AS VARCHAR) END AS chars, CAST(len({WORDS}) AS VARCHAR) AS words FROM documents""",
)
def for_embedding(spark, sf):
    metadata = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("chars"), F.lit("given")))
    one = C.for_embedding(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("int")), metadata)
    return docs(spark, sf).select("doc_id", one.alias("c")).select("doc_id", F.col("c.index").alias("index"), F.col("c.metadata")["chars"].alias("chars"), F.col("c.metadata")["words"].alias("words"))


@query("chk9_estimate", "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE greatest(1, length(text) // 800) END AS n FROM documents")
def estimate(spark, sf):
    return docs(spark, sf).select("doc_id", C.estimate(F.length("text")).alias("n"))


@query("chk10_chunk_id", "SELECT vec_id, 'file' || label || '_' || vec_id AS chunk_id FROM embeddings")
def chunk_id(spark, sf):
    return B.chunks(spark, sf).select(F.col("id").alias("vec_id"), C.chunk_id(F.col("file_id"), F.col("position")).alias("chunk_id"))


@query(
    "chk1_dispatch",
    f"""SELECT 'sentence' AS kind, doc_id, count(*) AS n_chunks FROM ({packed_sql("sentence", "text", 200, 40)}) GROUP BY doc_id
        UNION ALL SELECT unnest(['paragraph', 'unheard of']), doc_id, count(*) FROM ({packed_sql("paragraph", "text", 200, 40)}) GROUP BY doc_id
        UNION ALL SELECT 'token', doc_id, CAST(greatest(1, ceil((len(w) - 40) / 160.0)) AS BIGINT) FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0""",
)
def dispatch(spark, sf):
    """Chunks of each kind, asked for by its name; an unknown name is cut by paragraphs."""
    d = docs(spark, sf).select("doc_id", "text")
    made = [C.chunk(d, kind, 200, 40).select(F.lit(kind).alias("kind"), "doc_id") for kind in ("sentence", "paragraph", "unheard of", "token")]
    return reduce(lambda a, b: a.unionByName(b), made).groupBy("kind", "doc_id").agg(F.count("*").alias("n_chunks"))


@query("chk11_checked_rows", "SELECT count(*) AS n FROM documents WHERE trim(coalesce(text, '')) <> ''")
def checked_rows(spark, sf):
    C.check(1000, 200)
    return docs(spark, sf).filter(F.trim(F.coalesce("text", F.lit(""))) != "").agg(F.count("*").alias("n"))
