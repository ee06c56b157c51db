"""One query for each operator over the tables of a folder, and the SQL each
must agree with where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import Registry
from tidemark.llm.common import learnable, table
from tidemark.session import release

registry = Registry()


@registry.add("op6_fast_similarity_sketch")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@registry.add("op9_suffix_array_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"), length=400, columns=["doc_id", "text"], words=50, cut_words=False)
    # The contract goes by 400 bytes; passages of 50 words, which are often shorter, are shown beside it.
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeat"),
        "n_passage_bytes", (F.col("n_passage_bytes") > 0).alias("has_passage"),
    )


@registry.add("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.token_files import read_token_files, scratch_folder, write_token_files

    folder = scratch_folder(spark)
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, folder)


@registry.add("op2_output_codes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(learnable()))
    found = language.detect(docs, model)
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score", "ambiguous")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from tidemark.llm import toxicity

    labels = table(spark, sf_dir, "labels").filter(learnable()).select("doc_id", F.col("toxic").alias("label"))
    sample = toxicity.labelled_sample(docs, labels)
    model = toxicity.train(sample)
    release(sample)
    return model


@registry.add("op5_counterfactual_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")


_WORDS = r"list_filter(string_split_regex(lower(X), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@registry.add("op4_simhash_windows", rf"""
WITH d AS (SELECT doc_id, {_WORDS.replace("X", "text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.replace("X", "text")} AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) - 4 AS total, unnest(range(len(w) - 4)) AS pos, w FROM d WHERE len(w) >= 5),
dh AS (SELECT doc_id, total, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM ds),
it AS (SELECT item_id, len(w) - 4 AS m, unnest(range(len(w) - 4)) AS pos, w FROM i WHERE len(w) >= 5),
ih AS (SELECT item_id, m, array_to_string(w[pos + 1 : pos + 5], ' ') AS s, count(*) AS times FROM it GROUP BY ALL),
win AS (SELECT DISTINCT doc_id, item_id, m, least(m, total) AS size, least(pos, total - least(m, total)) AS start FROM dh JOIN ih USING (s)),
-- Shingles of items pos their places in documents, then those inside each window.
met AS (SELECT doc_id, item_id, pos, s, times FROM dh JOIN ih USING (s)),
bag AS (SELECT win.doc_id, win.item_id, m, size, start, s, least(count(*), min(times)) AS common
        FROM win JOIN met ON win.doc_id = met.doc_id AND win.item_id = met.item_id AND met.pos >= start AND met.pos < start + size GROUP BY ALL),
sim AS (SELECT doc_id, item_id, m, start, sum(common) / (m + size - sum(common)) AS similarity, sum(common) AS b, m + size AS both_sizes
        FROM bag GROUP BY doc_id, item_id, m, size, start),
ok AS (SELECT * FROM sim WHERE 100 * b >= 80 * (both_sizes - b))
SELECT doc_id, item_id, similarity::DOUBLE AS similarity, start::INTEGER AS start, (m + 4)::INTEGER AS n_words FROM ok
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registry.add("op8_one_permutation_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


@registry.add("op7_conflict_best_fit")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_duplicates import near_duplicates
    from tidemark.llm.packing import best_fit
    from tidemark.session import checkpointed

    docs = table(spark, sf_dir, "documents")
    near = near_duplicates(docs, words=5, percent=80, with_texts=True)
    return best_fit(docs, clusters=checkpointed(near.select("doc_id", "text_hash", F.hex("component").alias("cluster"), "n_words")))


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, two levels of ids; every
    64th is a licence file of its directory, every 1024th one of that above."""
    name = F.when(F.col("doc_id") % 64 == 0, "LICENSE.txt").otherwise(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    upper, lower = F.floor(F.col("doc_id") / 1024).cast("string"), F.floor(F.col("doc_id") / 64).cast("string")
    path = F.when(F.col("doc_id") % 1024 == 0, F.concat_ws("/", F.lit("corpus"), upper, name)).otherwise(
        F.concat_ws("/", F.lit("corpus"), upper, lower, name)
    )
    return docs.select(path.alias("path"), "text")


def _license_sql() -> str:
    from tidemark.llm.licenses import LICENSE_FILES, TEMPLATES, THRESHOLD

    words = lambda column: _WORDS.replace("X", column)
    rows = ", ".join("('" + k + "', '" + t + "')" for k, t in TEMPLATES)
    names = ", ".join(f"'{n}'" for n in LICENSE_FILES)
    return rf"""
WITH t AS (SELECT license, unnest({words('text')}) AS word FROM (VALUES {rows}) v(license, text)),
tt AS (SELECT license, word, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT 'corpus/' || (doc_id // 1024) || CASE WHEN doc_id % 1024 = 0 THEN '' ELSE '/' || (doc_id // 64) END || '/' ||
      CASE WHEN doc_id % 64 = 0 THEN 'LICENSE.txt' ELSE 'doc_' || doc_id || '.txt' END AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS total FROM f),
seen AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT path, unnest({words('text')}) AS word FROM f) WHERE word IN (SELECT word FROM tt) GROUP BY word),
idf AS (SELECT word, ln((1 + total) / (1 + coalesce(df, 0))) + 1 AS weight FROM (SELECT DISTINCT word FROM tt) LEFT JOIN seen USING (word), n),
tv AS (SELECT license, word, tf * weight AS value, sqrt(sum((tf * weight) ** 2) OVER (PARTITION BY license)) AS norm FROM tt JOIN idf USING (word)),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM f),
lw AS (SELECT path, line_no, word, count(*) AS tf FROM (SELECT path, line_no, unnest({words('line')}) AS word FROM l) GROUP BY ALL),
lv AS (SELECT path, line_no, word, tf * coalesce(weight, ln(1 + total) + 1) AS w FROM lw LEFT JOIN idf USING (word), n),
ln AS (SELECT path, line_no, sqrt(sum(w * w)) AS line_norm FROM lv GROUP BY ALL),
dot AS (SELECT path, line_no, license, sum(w * value) / min(norm) AS d FROM lv JOIN tv USING (word) GROUP BY ALL),
s AS (SELECT path, license, round(d / line_norm, 6) AS score FROM dot JOIN ln USING (path, line_no)),
own AS (SELECT path, license, score FROM s WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
h AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, score, path AS from_path FROM own
      WHERE lower(regexp_extract(path, '([^/.]*)[^/]*$', 1)) IN ({names})
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
near AS (SELECT f.path, h.* FROM f JOIN h ON starts_with(f.path, dir || '/') QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(dir) DESC) = 1)
SELECT f.path, coalesce(own.license, near.license) AS license, coalesce(own.score, near.score) AS score,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.license IS NOT NULL THEN f.path ELSE near.from_path END AS from_path
FROM f LEFT JOIN own USING (path) LEFT JOIN near ON near.path = f.path"""


@registry.add("op10_license_scan", _license_sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import licenses

    return licenses(files_of(table(spark, sf_dir, "documents")))


@registry.add("op3_wrapper_induction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pages import extract

    return extract(table(spark, sf_dir, "pages"))


_FIM_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS d FROM documents),
k AS (SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS c2,
      ('0x' || substr(d, 17, 8))::BIGINT % 100 AS p3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS p4 FROM h),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain' WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@registry.add("op11_fill_in_middle", _FIM_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fill_in_middle import digests

    return digests(table(spark, sf_dir, "documents"))


def _codes_sql() -> str:
    """Three assignments and two averages, one after the other."""
    distance = " + ".join(f"(x.v[{i}] - k.v[{i}]) * (x.v[{i}] - k.v[{i}])" for i in range(1, 5))
    near = lambda book: (
        f"SELECT vec_id, p, v, (min(d * 64 + e) % 64) AS e, min(d) AS d FROM "
        f"(SELECT x.vec_id, x.p, x.v, k.e, {distance} AS d FROM x JOIN {book} k ON x.p = k.p) GROUP BY vec_id, p, v"
    )
    mean = ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in range(1, 5))
    update = lambda book, codes: (
        f"SELECT k.p, k.e, coalesce(n.v, k.v) AS v FROM {book} k LEFT JOIN "
        f"(SELECT p, e, [{mean}] AS v FROM {codes} GROUP BY p, e) n ON k.p = n.p AND k.e = n.e"
    )
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS v FROM kept, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({near("b0")}), b1 AS MATERIALIZED ({update("b0", "a0")}),
a1 AS MATERIALIZED ({near("b1")}), b2 AS MATERIALIZED ({update("b1", "a1")}),
a2 AS MATERIALIZED ({near("b2")}),
codes AS (SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books"""


@registry.add("op12_vector_codes", _codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.vector_codes import codebooks_digest, compress, with_label_errors

    coded, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256")
    )


@registry.add("op13_bpe_automaton")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe_automaton import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
