"""Queries over text cleaning, chunking and metadata."""

from pyspark.sql import functions as F

from ..operators import chunk, clean, meta
from .registry import query
from .views import EPISODES, episodes, table



def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


_BROKEN = (("é", "Ã©"), ("'", "â€™"), (", ", "Â, "), (". ", 'â€". '))


@query(
    "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(broken, 'â€™', ''''), 'â€œ', '\"'), 'â€' || chr(157), '\"'), 'â€\"', '–'), 'Â', ''), 'â' || chr(128) || chr(153), ''''), 'â' || chr(128) || chr(156), '\"'), 'â' || chr(128) || chr(157), '\"') AS fixed"
    " FROM (SELECT doc_id, replace(replace(replace(replace(text, 'é', 'Ã©'), '''', 'â€™'), ', ', 'Â, '), '. ', 'â€\". ') AS broken FROM documents)"
)
def c1_fix_mojibake(spark, d):
    text = F.col("text")
    for good, bad in _BROKEN:
        text = F.replace(text, F.lit(good), F.lit(bad))
    return _docs(spark, d).select("doc_id", clean.fix_mojibake(text).alias("fixed"))


@query()
def c2_unescape_entities(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(clean.unescape_entities(F.col("html")), 256).alias("digest"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<[^>]+>', '', 'g') AS plain FROM pages""")
def c3_strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", clean.strip_html(F.col("html")).alias("plain"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def c4_strip_xml(spark, d):
    return table(spark, d, "pages").select("page_id", clean.strip_xml(F.col("html")).alias("plain"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('## Head' || chr(10) || '**' || replace(text, ' the ', ' *the* ') || '** [a](b) `c`',
    '(?m)^#+\s*', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '_(.+?)_', '\1', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '```[^`]*```', '', 'gs'), '`([^`]+)`', '\1', 'g') AS plain FROM documents""")
def c5_strip_markdown(spark, d):
    text = F.concat(F.lit("## Head\n**"), F.replace("text", F.lit(" the "), F.lit(" *the* ")), F.lit("** [a](b) `c`"))
    return _docs(spark, d).select("doc_id", clean.strip_markdown(text).alias("plain"))


_PART = r"""[^\s<>"{}|\\^`[\]]"""


@query("SELECT page_id, regexp_replace('see ' || url || ' or ' || replace(url, '://', ' ') || ' now', '" + rf"https?://{_PART}+|www\.{_PART}+|{_PART}+\.(com|org|net|edu|gov|mil|int|co\.uk|de|fr|it|es|ru|jp|cn){_PART}*" + "', '', 'gi') AS plain FROM pages")
def c6_remove_urls(spark, d):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" or "), F.replace("url", F.lit("://"), F.lit(" ")), F.lit(" now"))
    return table(spark, d, "pages").select("page_id", clean.remove_urls(text).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g') AS plain FROM documents")
def c7_remove_emails(spark, d):
    return _docs(spark, d).select("doc_id", clean.remove_emails(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b', '', 'g'), '\b\(\d{3}\)\s?\d{3}[-.]?\d{4}\b', '', 'g'), '\b\d{3}\s\d{3}\s\d{4}\b', '', 'g'), '\+\d{1,3}[-.\s]?\d{1,14}\b', '', 'g') AS plain FROM documents")
def c8_remove_phones(spark, d):
    return _docs(spark, d).select("doc_id", clean.remove_phones(F.col("text")).alias("plain"))


@query("SELECT doc_id, nfc_normalize(text) AS normal FROM documents")
def c9_normalize_unicode(spark, d):
    return _docs(spark, d).select("doc_id", clean.normalize_unicode(F.col("text")).alias("normal"))


@query("SELECT doc_id, translate('“' || text || '”', '“”„‘’‚', '\"\"\"''''''') AS plain FROM documents")
def c10_plain_quotes(spark, d):
    return _docs(spark, d).select("doc_id", clean.plain_quotes(F.concat(F.lit("“"), "text", F.lit("”"))).alias("plain"))


@query("SELECT doc_id, translate(replace(replace(replace(text, ' ', '—'), '—', '--'), '―', '--'), '–−‒', '---') AS plain FROM documents")
def c11_plain_dashes(spark, d):
    return _docs(spark, d).select("doc_id", clean.plain_dashes(F.replace("text", F.lit(" "), F.lit("—"))).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, '.', chr(9)), chr(9), ' '), ' +', ' ', 'g'), '[\t\f\x0B]+', ' ', 'g') AS plain FROM documents")
def c13_squeeze_spaces(spark, d):
    return _docs(spark, d).select("doc_id", clean.squeeze_spaces(clean.tabs_to_spaces(F.replace("text", F.lit("."), F.lit("\t")))).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(text, '.', chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') AS plain FROM documents")
def c14_squeeze_newlines(spark, d):
    return _docs(spark, d).select("doc_id", clean.strip_ends(clean.squeeze_newlines(F.replace("text", F.lit("."), F.lit("\n\n")))).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '.', '.....'), ',', chr(13) || chr(10)), '\r\n?', chr(10), 'g'), '\.{4,}', '...', 'g'), '!{2,}', '!', 'g') AS plain FROM documents")
def c16_builtin_rules(spark, d):
    text = F.replace(F.replace("text", F.lit("."), F.lit(".....")), F.lit(","), F.lit("\r\n"))
    return _docs(spark, d).select("doc_id", clean.calm_punctuation(clean.unix_newlines(clean.drop_zero_width(text))).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '[aeiou]#', '*', 'g') AS plain FROM documents")
def c17_custom_rules(spark, d):
    rules = [clean.Rule("late", "[aeiou]#", "*", 1), clean.Rule("early", "[0-9]+", "#", 5), clean.Rule("off", ".", "", 9, False)]
    return _docs(spark, d).select("doc_id", clean.apply_rules(F.col("text"), rules).alias("plain"))


@query("SELECT doc_id, lower(text) AS low, upper(replace(text, 'ß', 's')) AS up FROM documents")
def c18_change_case(spark, d):
    return _docs(spark, d).select("doc_id", clean.change_case(F.col("text"), "lower").alias("low"), clean.change_case(F.replace("text", F.lit("ß"), F.lit("s")), "upper").alias("up"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 40), chr(10)) AS plain FROM documents")
def c19_drop_short_lines(spark, d):
    return _docs(spark, d).select("doc_id", clean.drop_short_lines(F.col("text"), 40).alias("plain"))


@query(r"SELECT doc_id, regexp_replace(replace(text, ' the ', '-' || chr(10) || 'the '), '([\p{L}\p{N}_]+)-[ \t\r\f]*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g') AS plain FROM documents")
def c20_join_hyphenated(spark, d):
    return _docs(spark, d).select("doc_id", clean.join_hyphenated(F.replace("text", F.lit(" the "), F.lit("-\nthe "))).alias("plain"))


@query(r"""WITH c AS (SELECT doc_id, text AS a, regexp_replace(text, '[0-9]+', '', 'g') AS b FROM documents)
    SELECT doc_id, CAST(length(a) AS INTEGER) AS chars_before, CAST(length(b) AS INTEGER) AS chars_after, CAST(length(a) - length(replace(a, chr(10), '')) + 1 AS INTEGER) AS lines_before, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS lines_after,
    CAST(len(regexp_extract_all(a, '[^\s]+')) AS INTEGER) AS words_before, CAST(len(regexp_extract_all(b, '[^\s]+')) AS INTEGER) AS words_after, CAST(length(a) - length(b) AS INTEGER) AS removed, round(CASE WHEN length(a) > 0 THEN 100.0 * (length(a) - length(b)) / length(a) ELSE 0.0 END, 4)::DOUBLE AS removed_percent FROM c""")
def c21_text_stats(spark, d):
    return _docs(spark, d).select("doc_id", clean.text_stats(F.col("text"), F.regexp_replace("text", "[0-9]+", "")).alias("s")).select("doc_id", "s.*")


@query(r"SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, '�') THEN 'replacement_character' END, CASE WHEN regexp_matches(text, '\s{10,}') THEN 'long_whitespace' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN 'control_characters' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents")
def c22_validate_text(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_except(clean.validate_text(F.col("text")), F.array(F.lit("many_scripts"))), ",").alias("problems"))


@query()
def c23_clean_preview(spark, d):
    short = table(spark, d, "pages").select("page_id", F.left("html", F.lit(500)).alias("html"))
    return clean.clean_text(short, "html").select("page_id", "cleaned", F.array_join("rules_applied", ",").alias("rules"))


_CLEAN_EPISODE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), '[ \t]+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"""


@query(f"SELECT doc_id, {_CLEAN_EPISODE.format('text')} AS cleaned FROM documents")
def c24_clean_episode(spark, d):
    return _docs(spark, d).select("doc_id", clean.clean_episode(F.col("text")).alias("cleaned"))


_FIXED = """SELECT {key}, s AS start, s + 1000 AS "end", substr({text}, s + 1, 1000) AS content FROM (SELECT *, unnest(range(0, length({text}), 800))::INTEGER AS s FROM {source} WHERE length({text}) > 0)"""
CHUNKS = f"""v_chunk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_index, content, start, "end" FROM ({_FIXED.format(key='doc_id', text='text', source='documents')}) WHERE length(trim(content)) >= 50)"""


def chunks(spark, d):
    return chunk.chunk_fixed(_docs(spark, d), "doc_id", "text")


@query(f"WITH {CHUNKS} SELECT * FROM v_chunk")
def d1_chunk_fixed(spark, d):
    return chunks(spark, d)


@query()
def d2_chunk_recursive(spark, d):
    return chunk.chunk_recursive(_docs(spark, d), "doc_id", "text")


@query()
def d3_chunk_character(spark, d):
    return chunk.chunk_character(_docs(spark, d), "doc_id", "text", "\n", 400, 80)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, len(t), 150)) AS s FROM t WHERE len(t) > 0)
    SELECT doc_id, CAST(s // 150 AS INTEGER) AS chunk_index, array_to_string(list_slice(t, s + 1, s + 200), ' ') AS content FROM w""")
def d4_chunk_tokens(spark, d):
    return chunk.chunk_tokens(_docs(spark, d), "doc_id", "text")


@query()
def d5_chunk_sentences(spark, d):
    return chunk.chunk_sentences(_docs(spark, d), "doc_id", "text")


@query()
def d6_chunk_html_headers(spark, d):
    return chunk.chunk_html_headers(table(spark, d, "pages"), "page_id", "html")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, length(content) > 900 AS too_long FROM v_chunk WHERE length(content) >= 300")
def d9_quality_control(spark, d):
    return chunk.quality_control(chunks(spark, d), 300, 900).select("doc_id", "chunk_index", "too_long")


@query(f"""WITH {CHUNKS}, p AS (SELECT *, lag(length(content) < 700) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS was FROM v_chunk),
    r AS (SELECT *, sum(CASE WHEN length(content) < 700 AND coalesce(was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS run FROM p)
    SELECT doc_id, min(chunk_index) AS chunk_index, string_agg(content, chr(10) ORDER BY chunk_index) AS content, string_agg(chunk_index, ',' ORDER BY chunk_index) AS merged FROM r GROUP BY doc_id, run""")
def d10_merge_small(spark, d):
    return chunk.merge_small(chunks(spark, d), "doc_id", 700).withColumn("merged", F.array_join(F.col("merged").cast("array<string>"), ","))


@query()
def d11_chunk_boundary_aware(spark, d):
    return chunk.chunk_boundary_aware(_docs(spark, d), "doc_id", "text")


@query("""WITH m(model, max_tokens) AS (VALUES ('src0', 512), ('src1', 8192), ('src2', 2048)), t AS (SELECT doc_id, CAST(floor(coalesce(max_tokens, 512) * 0.85) AS INTEGER) AS threshold, CAST(ceil(length(text) / 1.55) AS INTEGER) AS tokens FROM documents LEFT JOIN m ON source = model),
    s AS (SELECT *, CAST(greatest(500, least(15000, floor(threshold * 1.55))) AS INTEGER) AS chunk_size FROM t) SELECT doc_id, threshold, tokens, chunk_size, CAST(greatest(50, least(2000, floor(chunk_size * 0.133))) AS INTEGER) AS chunk_overlap, tokens > threshold AS needs_chunking FROM s""")
def d12_chunk_policy(spark, d):
    models = spark.createDataFrame([("src0", 512), ("src1", 8192), ("src2", 2048)], "model string, max_tokens int")
    docs = table(spark, d, "documents").withColumnRenamed("source", "model")
    return chunk.chunk_policy(docs, "text", models, "model").select("doc_id", "threshold", "tokens", "chunk_size", "chunk_overlap", "needs_chunking")


@query(f"""WITH {CHUNKS}, {EPISODES} SELECT doc_id AS episode_id, chunk_index, doc_id || '_' || chunk_index AS chunk_id, doc_id * 1000 + chunk_index AS entry_id, novel_id, episode_number, left(episode_title || ' [Chunk ' || (chunk_index + 1) || '/' || count(*) OVER (PARTITION BY doc_id) || ']', 500) AS title,
    left(v_chunk.content, 20000) AS content, count(*) OVER (PARTITION BY doc_id) AS total_chunks, publication_date FROM v_chunk JOIN v_episode ON doc_id = episode_id""")
def d13_chunk_rows(spark, d):
    return chunk.to_chunk_rows(chunks(spark, d).withColumnRenamed("doc_id", "episode_id"), episodes(spark, d), "episode_id")


@query(f"WITH {CHUNKS}, p AS (SELECT doc_id, count(*) AS n, sum(length(content)) AS chars, avg(length(content)) AS mean FROM v_chunk GROUP BY 1) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(chars) AS BIGINT) AS chars, round(avg(mean), 6) AS mean_of_means FROM p")
def d14_chunk_statistics(spark, d):
    return chunk.chunk_statistics(chunks(spark, d), "doc_id")


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS INTEGER) AS word_count, CAST(len(list_filter(string_split(text, '.'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) AS INTEGER) AS sentence_count,
    CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')) <> '')) AS INTEGER) AS paragraph_count, CAST(length(text) AS INTEGER) AS char_count FROM documents""")
def e1_content_stats(spark, d):
    return _docs(spark, d).select("doc_id", *[c.alias(n) for n, c in meta.content_stats("text").items()])


@query("SELECT doc_id, sha256(text) AS content_hash, md5(doc_id || ':' || source || ':' || n_chars) AS record_hash, left(sha256(text), 16) AS query_hash FROM documents")
def e2_hashes(spark, d):
    from ..operators.reconcile import record_hash

    return table(spark, d, "documents").select("doc_id", meta.content_hash("text").alias("content_hash"), record_hash("doc_id", "source", "n_chars").alias("record_hash"), meta.query_hash("text").alias("query_hash"))


@query(f"WITH {CHUNKS} SELECT v_chunk.doc_id, chunk_index, lang, source FROM v_chunk JOIN documents USING (doc_id)")
def e3_inherit(spark, d):
    return meta.inherit(chunks(spark, d), table(spark, d, "documents"), "doc_id", ["lang", "source"]).select("doc_id", "chunk_index", "lang", "source")


@query(f"WITH {CHUNKS} SELECT v_chunk.doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN lang ELSE 'own' END AS custom_lang, source AS custom_source, 2::INTEGER AS n FROM v_chunk JOIN documents USING (doc_id)")
def e3_inherit_custom(spark, d):
    """Custom keys of a document's map on its chunks; other keys stay away, and a chunk's own entry wins."""
    parents = table(spark, d, "documents").withColumn("m", F.create_map(F.lit("custom_lang"), "lang", F.lit("custom_source"), "source", F.lit("private"), F.lit("x")))
    own = chunks(spark, d).withColumn("m", F.when(F.col("chunk_index") % 2 == 1, F.create_map(F.lit("custom_lang"), F.lit("own"))))
    out = meta.inherit(own, parents, "doc_id", [], custom="m")
    return out.select("doc_id", "chunk_index", F.col("m")["custom_lang"].alias("custom_lang"), F.col("m")["custom_source"].alias("custom_source"), F.size("m").alias("n"))


@query(f"""WITH {EPISODES} SELECT -(episode_id * 1000 + 999) AS entry_id, episode_id, novel_id, episode_number, left(episode_title, 500) AS title, left(content, 20000) AS content, CAST(length(content) AS INTEGER) AS content_length, false AS is_chunk, -1::INTEGER AS chunk_index, 1::INTEGER AS total_chunks,
    CAST(epoch(publication_date) AS BIGINT) AS publication_timestamp, publication_date::VARCHAR AS publication_date FROM v_episode""")
def d13_document_rows(spark, d):
    return chunk.to_document_rows(episodes(spark, d), "episode_id")


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, lag(chunk_index) OVER w AS previous_chunk, lead(chunk_index) OVER w AS next_chunk FROM v_chunk WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")
def e4_link_chunks(spark, d):
    return meta.link_chunks(chunks(spark, d), "doc_id").select("doc_id", "chunk_index", "previous_chunk", "next_chunk")


@query(f"""WITH {CHUNKS}, p AS (SELECT doc_id, chunk_index, content, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS b, lead(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM v_chunk)
    SELECT doc_id, chunk_index, CAST(coalesce(CASE WHEN b IS NULL THEN 0 ELSE list_max(list_filter(range(1, least(length(b), length(content), 250) + 1), lambda i: right(b, i) = left(content, i))) END, 0) AS INTEGER) AS overlap_previous, CAST(coalesce(list_max(list_filter(range(1, least(length(n), length(content), 250) + 1), lambda i: right(content, i) = left(n, i))), 0) AS INTEGER) AS overlap_next FROM p""")
def e5_overlaps(spark, d):
    return meta.overlaps(chunks(spark, d), "doc_id", 250).select("doc_id", "chunk_index", "overlap_previous", "overlap_next")


@query(f"WITH {CHUNKS} SELECT a.doc_id, a.chunk_index, b.chunk_index AS related_index FROM v_chunk a JOIN v_chunk b ON a.doc_id = b.doc_id AND abs(a.chunk_index - b.chunk_index) BETWEEN 1 AND 2")
def e6_related(spark, d):
    return meta.related(chunks(spark, d), "doc_id", 2)


@query("SELECT d.doc_id, coalesce('q' || quality, lang) AS lang, toxic::VARCHAR AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def e7_enrich(spark, d):
    new = table(spark, d, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"), "toxic")
    return meta.enrich(table(spark, d, "documents").select("doc_id", "lang"), new, ["doc_id"], ["lang"]).select("doc_id", "lang", F.col("custom")["toxic"].alias("toxic"))


@query("SELECT 'quality' AS field, count(*) - count(quality) AS missing FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count(*) - count(lang) FROM documents")
def e8_missing_fields(spark, d):
    return meta.missing_fields(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "lang"])


@query(f"WITH {CHUNKS}, p AS (SELECT doc_id, count(*) AS n FROM v_chunk GROUP BY 1) SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(n - 1) AS BIGINT) AS links, round(avg(n), 6) AS chunks_per_document FROM p")
def e9_collection_stats(spark, d):
    return meta.collection_stats(chunks(spark, d), "doc_id")


@query("SELECT doc_id, 'fixed' AS strategy, '1000' AS size, 'clean>chunk' AS steps, '1' AS version, TIMESTAMP '2024-02-01 00:00:00' AS processed_at FROM documents")
def e12_provenance(spark, d):
    out = meta.provenance(_docs(spark, d), "fixed", {"size": "1000"}, ["clean", "chunk"], "1", "2024-02-01 00:00:00")
    return out.select("doc_id", "strategy", F.col("parameters")["size"].alias("size"), F.array_join("steps", ">").alias("steps"), "version", "processed_at")


_CLEAN_QUERY = r"SELECT conv_id, turn, trim(regexp_replace(" + "replace(" * len(clean.CONTRACTIONS) + r"lower(regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '[\t\f\x0B]+', ' ', 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'))" + "".join(f", '{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in clean.CONTRACTIONS) + r", '\s+', ' ', 'g')) AS cleaned FROM conversations"


@query(_CLEAN_QUERY)
def c25_clean_query(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", clean.clean_query(F.col("text")).alias("cleaned"))


@query(_CLEAN_QUERY)
def c25_clean_queries(spark, d):
    """The whole cleaning before the query's own steps; these texts have nothing that its other steps change, which tests do."""
    return clean.clean_queries(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text").select("conv_id", "turn", "cleaned")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]')) AS INTEGER) AS digits FROM documents")
def e10_extractors(spark, d):
    """A user's own field beside the content."""
    meta.register_extractor("digits", lambda c: F.regexp_count(c, F.lit("[0-9]")))
    return meta.with_extractors(_docs(spark, d), "text").select("doc_id", "digits")


@query("SELECT doc_id, lang FROM documents WHERE source <> 'src5'")
def e11_delete_metadata(spark, d):
    from ..sources.tables import delete_where

    return delete_where(table(spark, d, "documents").select("doc_id", "lang", "source"), F.col("source") == "src5").drop("source")
