"""The registered queries, each over its whole table, and the SQL that says the same.

Values are rounded to 6 digits on both sides; what is not defined (NaN) is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import cells, measures
from glossa.functions.tokenise import Tokeniser
from glossa.operators.base import shared_dir, spread, written
from glossa.operators.decompose import PCA, TruncatedSVD
from glossa.operators.index import LinearScanIndex, LSHIndex
from glossa.operators.lda import LatentDirichletAllocation
from glossa.operators.linalg import col_do, col_nonzero_do, normalise, sparse_matmul, to_arrays
from glossa.operators.lsh import ClassicLSH, LSHForest
from glossa.operators.randproj import TERM_BASED, RandomIndexing, RandomProjection, SignRandomProjection, SimHash, bit_string
from glossa.operators.vectorise import CountVectoriser, HashingVectoriser
from glossa.operators.weighting import Tfidf
from glossa.plans.pipeline import Pipeline
from glossa.streaming import online

STOP_WORDS = ("the", "of", "and", "in", "to", "is", "that", "de", "la", "le", "et", "der", "die", "und", "que", "el")
FEATURES, K, DENSITY, SEED = 260_000, 8, 0.25, 5
FUNCTIONS, TABLES, NEAREST = 7, 100, 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text"), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")), "id")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that searches ask with: every row whose id is divisible by 50, against all rows."""
    return vectors(spark, sf_dir).where("id % 50 = 0")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        x = F.col(c)
        df = df.withColumn(c, F.when(F.isnan(x), None).otherwise(F.round(x, digits) + F.lit(0.0)))
    return df


# ---- SQL that several queries share ---------------------------------------------------------------------------

_TOKENS = r"t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents), k AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS term FROM t)"
_VOCABULARY = _TOKENS + ", f AS (SELECT term, min(doc_id * 1000000000 + pos) AS first FROM k GROUP BY term), v AS (SELECT term, row_number() OVER (ORDER BY first) - 1 AS term_idx FROM f)"
_COUNTS = _VOCABULARY + ", m AS (SELECT doc_id, term_idx, CAST(count(*) AS DOUBLE) AS value FROM k JOIN v USING (term) GROUP BY ALL)"
_IDF = "i AS (SELECT term_idx, ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1.0 + count(*))) AS idf FROM m GROUP BY term_idx)"
_HOLDOUT = (
    r"t AS MATERIALIZED (SELECT doc_id, lang, regexp_extract_all(lower(text), '\p{L}+') AS t FROM documents)"
    + ", k AS MATERIALIZED (SELECT doc_id, lang, unnest(range(len(t))) AS pos, unnest(t) AS term FROM t), f AS (SELECT term, min(doc_id * 1000000000 + pos) AS first FROM k WHERE lang = 'en' GROUP BY term)"
    + ", v AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY first) - 1 AS term_idx FROM f)"
    + ", m AS MATERIALIZED (SELECT doc_id, lang, term_idx, CAST(count(*) AS DOUBLE) AS value FROM k JOIN v USING (term) GROUP BY ALL)"
)
_MATRIX = "SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, value FROM m"


# ---- tokens and counts ----------------------------------------------------------------------------------------


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM k")
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tokeniser().for_each_in(documents(spark, sf_dir))


@query(
    rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda x: NOT list_contains({list(STOP_WORDS)}, x)) AS t FROM documents)
    SELECT doc_id, CAST(unnest(range(len(t))) AS INTEGER) AS pos, unnest(t) AS term FROM t"""
)
def tokenise_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tokeniser(STOP_WORDS).for_each_in(documents(spark, sf_dir))


@query(f"WITH {_VOCABULARY} SELECT term, CAST(term_idx AS INTEGER) AS term_idx FROM v")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CountVectoriser().fit(documents(spark, sf_dir)).vocabulary


@query(f"WITH {_COUNTS} {_MATRIX}")
def count_vectorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CountVectoriser().fit_transform(documents(spark, sf_dir))


@query(f"WITH {_HOLDOUT} {_MATRIX}")
def count_vectorise_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the English documents, applied to all: terms that those lack are dropped."""
    return CountVectoriser().fit(english(spark, sf_dir)).transform(documents(spark, sf_dir))


def _sql_murmur(term: str) -> str:
    """MurmurHash3 of the UTF-8 bytes of ``term``, in steps of lists over its hexadecimal form."""
    m32 = "4294967296"
    rot = lambda x, r: f"(({x}) << {r}) % {m32} + (({x}) >> {32 - r})"
    word = lambda i: "+".join(f"(('0x' || h[{i} * 8 + {2 * j + 1}:{i} * 8 + {2 * j + 2}])::UINTEGER::HUGEINT << {8 * j})" for j in range(4))
    mixed = lambda x: f"list_transform([list_transform([({x}) * 3432918353 % {m32}], lambda q: {rot('q', 15)})[1] * 461845907 % {m32}], lambda q: q::HUGEINT)[1]"
    return f"""b AS (SELECT {term}, hex(encode({term})) AS x, octet_length(encode({term})) AS n FROM d),
    h AS (SELECT {term}, n, n // 4 AS nb, rpad(x, CAST((n // 4 + 1) * 8 AS INTEGER), '0') AS h FROM b),
    w AS (SELECT {term}, n, nb, list_transform(range(nb + 1), lambda i: {mixed(word('i'))}) AS w FROM h),
    r AS (SELECT {term}, n, w[nb + 1] AS tail, list_reduce(w[1:nb], lambda a, x: (list_transform([xor(a, x)], lambda q: {rot('q', 13)})[1] * 5 + 3864292196) % {m32}, 0::HUGEINT) AS a FROM w),
    f0 AS (SELECT {term}, xor(xor(a, tail), n::HUGEINT) AS y FROM r),
    f1 AS (SELECT {term}, xor(y, y >> 16) * 2246822507 % {m32} AS y FROM f0),
    f2 AS (SELECT {term}, xor(y, y >> 13) * 3266489909 % {m32} AS y FROM f1),
    hashed AS (SELECT {term}, xor(y, y >> 16) AS hash FROM f2)"""


@query(
    f"""WITH {_TOKENS}, c AS (SELECT doc_id, term, count(*) AS n FROM k GROUP BY ALL), d AS (SELECT DISTINCT term FROM c), {_sql_murmur('term')}
    SELECT doc_id, CAST(hash % {FEATURES} AS INTEGER) AS term_idx, CAST(sum(c.n) AS DOUBLE) AS value FROM c JOIN hashed USING (term) GROUP BY ALL"""
)
def hashing_vectorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HashingVectoriser(FEATURES).fit_transform(documents(spark, sf_dir))


# ---- weighting ------------------------------------------------------------------------------------------------


def _idf(docs: DataFrame) -> Tfidf:
    weighting = Tfidf()
    Pipeline(CountVectoriser(), weighting).fit(docs)
    return weighting


@query(f"WITH {_COUNTS}, {_IDF} SELECT CAST(term_idx AS INTEGER) AS term_idx, round(idf, 6) AS idf FROM i")
def idf_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_idf(documents(spark, sf_dir)).idf, "idf")


@query(f"WITH {_COUNTS}, {_IDF} SELECT CAST(term_idx AS INTEGER) AS term_idx, round(idf, 6) AS idf FROM i".replace("lower(text)", "lower(CASE WHEN lang = 'en' THEN text ELSE '!!!' END)"))
def idf_empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts in other languages than English are emptied: documents without a term still count."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).otherwise("!!!").alias("text"))
    return rounded(_idf(spread(docs, "doc_id")).idf, "idf")


@query(f"WITH {_COUNTS}, {_IDF} SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, round(value * idf, 6) AS value FROM m JOIN i USING (term_idx)")
def tfidf_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Pipeline(CountVectoriser(), Tfidf()).fit_transform(documents(spark, sf_dir)), "value")


@query(
    f"""WITH {_HOLDOUT}, i AS (SELECT term_idx, ln((1 + (SELECT count(DISTINCT doc_id) FROM documents WHERE lang = 'en')) / (1.0 + count(*))) AS idf FROM m WHERE lang = 'en' GROUP BY term_idx)
    SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, round(value * idf, 6) AS value FROM m JOIN i USING (term_idx)"""
)
def tfidf_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = Pipeline(CountVectoriser(), Tfidf()).fit(english(spark, sf_dir))
    return rounded(fitted.transform(documents(spark, sf_dir)), "value")


@query(
    rf"""WITH t AS MATERIALIZED (SELECT doc_id, lang, regexp_extract_all(lower(text), '\p{{L}}+') AS t FROM documents), k AS (SELECT doc_id, lang, unnest(t) AS term FROM t),
    c AS MATERIALIZED (SELECT doc_id, lang, term, count(*) AS n FROM k GROUP BY ALL), d AS (SELECT DISTINCT term FROM c), {_sql_murmur('term')},
    m AS MATERIALIZED (SELECT doc_id, lang, hash % {FEATURES} AS term_idx, CAST(sum(c.n) AS DOUBLE) AS value FROM c JOIN hashed USING (term) GROUP BY ALL),
    n AS (SELECT count(DISTINCT doc_id) AS n FROM documents WHERE lang = 'en'), i AS (SELECT term_idx, ln((1 + (SELECT n FROM n)) / (1.0 + count(*))) AS idf FROM m WHERE lang = 'en' GROUP BY term_idx)
    SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, round(value * coalesce(idf, ln(1 + (SELECT n FROM n))), 6) AS value FROM m LEFT JOIN i USING (term_idx)"""
)
def tfidf_unseen_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed terms, weighted as in the English documents; those that none of them has weigh most."""
    fitted = Pipeline(HashingVectoriser(FEATURES), Tfidf()).fit(english(spark, sf_dir))
    return rounded(fitted.transform(documents(spark, sf_dir)), "value")


@query(ORACLES["idf_fit"])
def tfidf_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tfidf-{spark.sparkContext.applicationId}"
    _idf(documents(spark, sf_dir)).save(path)
    return rounded(Tfidf.load(spark, path).idf, "idf")


@query(
    f"""WITH {_COUNTS} SELECT doc_id, count(*) AS n_terms, sum(value) AS total, round(sqrt(sum(value * value)), 6) AS norm, CAST(min(term_idx) AS INTEGER) AS first_term FROM m GROUP BY doc_id"""
)
def column_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's column of the matrix, handed to a function as a whole."""
    import pandas as pd

    def about(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"]
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "n_terms": [len(pdf)], "total": [v.sum()], "norm": [(v * v).sum() ** 0.5], "first_term": [pdf["term_idx"].iloc[0]]})

    counts = CountVectoriser().fit_transform(documents(spark, sf_dir))
    return rounded(col_do(counts, about, "doc_id long, n_terms long, total double, norm double, first_term int"), "norm")


@query(f"WITH {_COUNTS} SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, value * value AS square FROM m")
def nonzero_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = CountVectoriser().fit_transform(documents(spark, sf_dir))
    return col_nonzero_do(counts, F.col("doc_id"), F.col("term_idx"), (F.col("value") * F.col("value")).alias("square"))


@query(f"WITH {_COUNTS} SELECT doc_id, CAST(term_idx AS INTEGER) AS term_idx, round(value / sum(value) OVER (PARTITION BY doc_id), 6) AS value FROM m")
def normalise_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(CountVectoriser().fit_transform(documents(spark, sf_dir)), "counts")
    return rounded(normalise(counts, "doc_id"), "value").select("doc_id", "term_idx", "value")


# ---- pairwise measures: every vector and the mean of its label's ------------------------------------------------

_MEANS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), xs AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(a) AS v FROM e),
cs AS (SELECT label, i, avg(v) AS y FROM xs GROUP BY label, i), l AS (SELECT label, list(y ORDER BY i) AS b FROM cs GROUP BY label), p AS (SELECT vec_id, a, b FROM e JOIN l USING (label))"""
_COS = "list_cosine_similarity(a, b)"
_DOT = "list_inner_product(a, b)"
_SIGNS = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] >= 0) <> (b[i] >= 0) THEN 1 ELSE 0 END)) / 64.0"
_MEASURES = {
    "cosine_similarity": _COS,
    "cosine_distance": f"1 - {_COS}",
    "angular_distance": f"acos(least({_COS}, 1)) / pi()",
    "angular_similarity": f"1 - acos(least({_COS}, 1)) / pi()",
    "hamming_distance": _SIGNS,
    "hamming_similarity": f"1 - {_SIGNS}",
    "euclidean_distance": "list_distance(a, b)",
    "manhattan_distance": "list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))",
    "vector_len_similarity": f"CASE WHEN {_DOT} > 0 THEN sqrt({_DOT}) END",
}


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    mean = e.select("label", F.posexplode("a").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("c"))
    lists = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("b"))
    return e.join(lists, "label").select("vec_id", "label", "a", "b")


def _measure(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        if name.startswith("hamming"):
            a, b = (F.transform(v, lambda x: (x >= 0).cast("int")) for v in (a, b))
        return rounded(_means(spark, sf_dir).select("vec_id", getattr(measures, name)(a, b).alias("value")), "value")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {_MEANS} SELECT vec_id, round({sql}, 6) + 0.0 AS value FROM p"


for _name, _sql in _MEASURES.items():
    _measure(_name, _sql)


# ---- signatures and indexes -----------------------------------------------------------------------------------

BITS = 60


def _signed(functions: int, tables: int) -> str:
    bits = functions * tables
    return f"""e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
h AS (SELECT bit, i, {cells.sql_integer_planes(SEED, 'bit', 'i')} AS w FROM (SELECT unnest(range({bits})) AS bit), (SELECT unnest(range(64)) AS i)),
hp AS (SELECT bit, CAST(list(w ORDER BY i) AS DOUBLE[]) AS w FROM h GROUP BY bit),
s AS (SELECT vec_id, string_agg(CASE WHEN list_inner_product(a, w) >= 0 THEN '1' ELSE '0' END, '' ORDER BY bit) AS bits FROM e, hp GROUP BY vec_id),
k AS (SELECT vec_id, t, substr(bits, t * {functions} + 1, {functions}) AS key FROM s, (SELECT unnest(range({tables})) AS t))"""


_BITS, _KEYS = _signed(10, BITS // 10), _signed(FUNCTIONS, TABLES)
_CANDIDATES = "c AS (SELECT DISTINCT q.vec_id AS query_id, k.vec_id AS id FROM k q JOIN k USING (t, key) WHERE q.vec_id % 50 = 0)"
_LCP = f"list_max(list_transform(range(0, {FUNCTIONS + 1}), lambda n: CASE WHEN substr(q.key, 1, n) = substr(k.key, 1, n) THEN n ELSE 0 END))"
_FOREST = f"""o AS (SELECT q.vec_id AS query_id, k.vec_id AS id, max({_LCP}) AS lcp FROM k q JOIN k USING (t) WHERE q.vec_id % 50 = 0 GROUP BY ALL),
g AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY lcp DESC) AS r FROM o), c AS (SELECT query_id, id FROM g WHERE r <= {NEAREST} OR lcp = {FUNCTIONS})"""


def _ranked(distance: str, pairs: str = "c") -> str:
    return f"""d AS (SELECT query_id, id, {distance} AS distance FROM {pairs}),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id DESC) AS rank FROM d)
    SELECT query_id, id, round(distance, 6) + 0.0 AS distance, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= {NEAREST}"""


def _found(df: DataFrame) -> DataFrame:
    return rounded(df.select("query_id", "id", "distance", F.col("rank").cast("int").alias("rank")), "distance")


def _round_first(measure: measures.Measure) -> measures.Measure:
    """Distances that differ by rounding only are ties in both engines."""
    return measures.Rounded(measure, 9)


def _hasher(bits: int = BITS) -> SimHash:
    return SimHash(bits, 64, SEED, integer_planes=True)


def _lsh(spark: SparkSession, sf_dir: str, approx: bool, scheme) -> LSHIndex:
    distance = None if approx else _round_first(measures.cosine_distance)
    return LSHIndex(approx, _hasher(FUNCTIONS * TABLES), scheme, distance).index(vectors(spark, sf_dir))


_ASKED = _MEANS + ", q AS (SELECT vec_id AS query_id, a AS b FROM e WHERE vec_id % 50 = 0)"


@query(f"WITH {_ASKED}, c AS (SELECT query_id, vec_id AS id, round(1 - list_cosine_similarity(b, a), 9) AS x FROM q, e), {_ranked('x')}")
def linear_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = LinearScanIndex(_round_first(measures.cosine_distance)).index(vectors(spark, sf_dir))
    return _found(index.search(asked(spark, sf_dir), NEAREST))


@query(f"WITH {_ASKED}, c AS (SELECT query_id, vec_id AS id, round(list_distance(b, a), 9) AS x FROM q, e WHERE label <> 3), {_ranked('x')}")
def linear_scan_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By Euclidean distance, after one label's vectors were removed; they still ask."""
    gone = read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    index = LinearScanIndex(_round_first(measures.euclidean_distance)).index(vectors(spark, sf_dir)).remove(gone)
    return _found(index.search(asked(spark, sf_dir), NEAREST))


@query(f"WITH {_BITS} SELECT vec_id AS id, bits FROM s")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = SignRandomProjection(BITS, SEED, integer_planes=True).fit_transform(vectors(spark, sf_dir))
    return signed.select("id", bit_string(F.col("words"), BITS).alias("bits"))


@query(
    f"""WITH {_MEANS}, {_BITS.replace('e AS', 'e0 AS', 1).replace('FROM e, hp', 'FROM both2, hp').replace('h AS (', 'both2 AS (SELECT vec_id * 2 AS vec_id, a FROM p UNION ALL SELECT vec_id * 2 + 1, b FROM p), h AS (', 1)}
    SELECT u.vec_id // 2 AS vec_id, round(1 - list_sum(list_transform(range(1, {BITS + 1}), lambda i: CASE WHEN u.bits[i] <> w.bits[i] THEN 1 ELSE 0 END)) / {BITS}.0, 6) AS value
    FROM s u JOIN s w ON w.vec_id = u.vec_id + 1 WHERE u.vec_id % 2 = 0"""
)
def srp_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming similarity of the packed signatures of a vector and its label's mean."""
    hasher = _hasher()
    both = hasher.hash(hasher.hash(_means(spark, sf_dir).select("vec_id", "a", "b"), "a", "x"), "b", "y")
    return rounded(both.select("vec_id", (1 - measures.packed_hamming_distance(F.col("x"), F.col("y"), BITS)).alias("value")), "value")


@query(f"WITH {_KEYS}, {_CANDIDATES} SELECT * FROM c")
def lsh_classic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir, True, ClassicLSH(FUNCTIONS, TABLES)).candidates(asked(spark, sf_dir), NEAREST)


_PAIR_COSINE = ", p AS (SELECT query_id, id, round(1 - list_cosine_similarity(x.a, y.a), 9) AS x FROM c JOIN e x ON x.vec_id = query_id JOIN e y ON y.vec_id = id), "
_PAIR_HAMMING = f", p AS (SELECT query_id, id, list_sum(list_transform(range(1, {FUNCTIONS * TABLES + 1}), lambda i: CASE WHEN x.bits[i] <> y.bits[i] THEN 1 ELSE 0 END)) / {FUNCTIONS * TABLES}.0 AS x FROM c JOIN s x ON x.vec_id = query_id JOIN s y ON y.vec_id = id), "


@query(f"WITH {_KEYS}, {_CANDIDATES}{_PAIR_COSINE}{_ranked('x', 'p')}")
def lsh_classic_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_lsh(spark, sf_dir, False, ClassicLSH(FUNCTIONS, TABLES)).search(asked(spark, sf_dir), NEAREST))


@query(f"WITH {_KEYS}, {_CANDIDATES}{_PAIR_HAMMING}{_ranked('x', 'p')}")
def lsh_classic_search_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_lsh(spark, sf_dir, True, ClassicLSH(FUNCTIONS, TABLES)).search(asked(spark, sf_dir), NEAREST))


@query(f"WITH {_KEYS}, {_CANDIDATES}{_PAIR_COSINE.replace('y.vec_id = id)', 'y.vec_id = id WHERE y.label <> 3)')}{_ranked('x', 'p')}")
def lsh_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return _found(_lsh(spark, sf_dir, False, ClassicLSH(FUNCTIONS, TABLES)).remove(gone).search(asked(spark, sf_dir), NEAREST))


@query(f"WITH {_KEYS}, {_FOREST} SELECT * FROM c")
def lsh_forest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir, True, LSHForest(FUNCTIONS, TABLES)).candidates(asked(spark, sf_dir), NEAREST)


@query(f"WITH {_KEYS}, {_FOREST}{_PAIR_COSINE}{_ranked('x', 'p')}")
def lsh_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(_lsh(spark, sf_dir, False, LSHForest(FUNCTIONS, TABLES)).search(asked(spark, sf_dir), NEAREST))


# ---- random projections ---------------------------------------------------------------------------------------


def _signs(index: str) -> str:
    return cells.sql_sign(SEED, "comp", index, DENSITY)


_COMPS = f"j AS (SELECT unnest(range({K})) AS comp)"
_SCALE = f"(sqrt(1 / {DENSITY}) / sqrt({K}))"
_TERM_SIGNS = f"g AS (SELECT term_idx, comp, {_signs('term_idx')} AS sign FROM (SELECT DISTINCT term_idx FROM m), j)"
_DOC_SIGNS = f"g AS (SELECT doc_id, comp, {_signs('doc_id')} AS sign FROM (SELECT DISTINCT doc_id FROM m), j)"
_CONTEXTS = "c0 AS (SELECT term_idx, comp, sum(value * sign) AS value FROM m JOIN g USING (doc_id) WHERE sign <> 0 GROUP BY ALL)"
_REFLECT = "r0 AS (SELECT doc_id, comp, sum(c0.value * m.value) AS value FROM c0 JOIN m USING (term_idx) GROUP BY ALL), c1 AS (SELECT term_idx, comp, sum(r0.value * m.value) AS value FROM r0 JOIN m USING (doc_id) GROUP BY ALL)"


def _applied(contexts: str) -> str:
    return f"SELECT doc_id, CAST(comp AS INTEGER) AS comp, round(sum(m.value * x.value) * {_SCALE}, 6) + 0.0 AS value FROM m JOIN {contexts} x USING (term_idx) GROUP BY doc_id, comp"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(CountVectoriser().fit_transform(documents(spark, sf_dir)), "counts")


@query(f"WITH {_COUNTS}, {_COMPS}, {_TERM_SIGNS}, x0 AS (SELECT term_idx, comp, sign AS value FROM g WHERE sign <> 0) {_applied('x0')}")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = CountVectoriser().fit_transform(documents(spark, sf_dir))
    return rounded(RandomProjection(K, DENSITY, SEED).fit_transform(counts), "value")


@query(f"WITH {_COUNTS}, {_COMPS}, {_DOC_SIGNS}, {_CONTEXTS} {_applied('c0')}")
def random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(RandomIndexing(K, DENSITY, seed=SEED).fit_transform(_counts(spark, sf_dir)), "value")


_COMPONENTS = f"SELECT CAST(term_idx AS INTEGER) AS term_idx, CAST(comp AS INTEGER) AS comp, round(value * {_SCALE}, 6) + 0.0 AS value FROM"


@query(f"WITH {_COUNTS}, {_COMPS}, {_DOC_SIGNS}, {_CONTEXTS} {_COMPONENTS} c0")
def ri_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported, taken in by another model and exported again."""
    model = RandomIndexing(K, DENSITY, seed=SEED).fit(_counts(spark, sf_dir))
    return rounded(RandomIndexing(K, DENSITY).set_components(model.components()).components(), "value")


@query(ORACLES["ri_components"])
def ri_partial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as a first batch, the others as a second."""
    counts = _counts(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    model = RandomIndexing(K, DENSITY, seed=SEED)
    for batch in ("lang = 'en'", "lang <> 'en' OR lang IS NULL"):
        model.partial_fit(counts.where(batch).drop("lang"))
    return rounded(model.components(), "value")


_UNITS = "SELECT CAST(term_idx AS INTEGER) AS term_idx, CAST(comp AS INTEGER) AS comp, CAST(value AS BIGINT) AS units FROM c1"


def _units(model: RandomIndexing) -> DataFrame:
    """Components in units of the scale: whole numbers, compared to the last digit."""
    return model.components().select("term_idx", "comp", F.round(F.col("value") / model.scale).cast("long").alias("units"))


@query(f"WITH {_COUNTS}, {_COMPS}, {_DOC_SIGNS}, {_CONTEXTS}, {_REFLECT} {_UNITS}")
def rri_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(RandomIndexing(K, DENSITY, reflections=1, seed=SEED).fit(_counts(spark, sf_dir)))


@query(f"WITH {_COUNTS}, {_COMPS}, {_TERM_SIGNS}, c0 AS (SELECT term_idx, comp, sign AS value FROM g WHERE sign <> 0), {_REFLECT} {_UNITS}")
def rri_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(RandomIndexing(K, DENSITY, TERM_BASED, 1, SEED).fit(_counts(spark, sf_dir)))


@query(
    f"""WITH {_TOKENS}, c AS (SELECT doc_id, term, count(*) AS n FROM k GROUP BY ALL), d AS (SELECT DISTINCT term FROM c), {_sql_murmur('term')},
    m AS (SELECT doc_id, hash % {FEATURES} AS term_idx, CAST(sum(c.n) AS DOUBLE) AS value FROM c JOIN hashed USING (term) GROUP BY ALL), {_COMPS}, {_DOC_SIGNS}, {_CONTEXTS}
    {_COMPONENTS} c0"""
)
def ri_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random indexing of the documents as a stream, with hashed terms."""
    schema = read(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").select("doc_id", "text")
    model = RandomIndexing(K, DENSITY, seed=SEED)
    checkpoint = written(spark.range(1), "stream").inputFiles()[0].rpartition("/")[0] + "-state"
    run = online.fit_online(stream, HashingVectoriser(FEATURES), model, checkpoint)
    run.awaitTermination()
    return rounded(model.components(), "value")


# ---- decompositions and topics --------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings), v AS (SELECT i, var_samp(v) AS v FROM x GROUP BY i)
    SELECT round(sum(v), 6) AS total_variance FROM v"""
)
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances of all components add up to those of all places."""
    found = PCA(10).fit(vectors(spark, sf_dir)).explained_variance()
    return rounded(spark.createDataFrame([(float(found.sum()),)], "total_variance double"), "total_variance")


@query()
def pca_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PCA(10).fit_transform(vectors(spark, sf_dir)).select("id", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


_LENGTHS = "SELECT vec_id AS id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS squares FROM embeddings"


@query(_LENGTHS)
def pca_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components are a turn of the axes: a vector's squared scores add up to its squared length."""
    scores = PCA(64).fit_transform(vectors(spark, sf_dir))
    return rounded(scores.select("id", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x * x).alias("squares")), "squares")


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS product FROM range(64) a(i), range(64) b(j)")
def pca_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the components with each other."""
    c = PCA(64).fit(vectors(spark, sf_dir)).components()
    products = c.T @ c
    rows = [(i, j, float(products[i, j])) for i in range(64) for j in range(64)]
    return rounded(spark.createDataFrame(rows, "i int, j int, product double"), "product")


@query(_LENGTHS)
def svd_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the singular vectors of the embeddings, all of them."""
    entries = vectors(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode("vec").alias("term_idx", "value"))
    scores = TruncatedSVD(64).fit_transform(entries)
    return rounded(scores.groupBy(F.col("doc_id").alias("id")).agg(F.sum(F.col("value") * F.col("value")).alias("squares")), "squares")


@query("SELECT round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 4) AS squares FROM embeddings")
def svd_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared singular values add up to the squared entries."""
    entries = vectors(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode("vec").alias("term_idx", "value"))
    found = TruncatedSVD(64).fit(entries).singular_values
    return rounded(spark.createDataFrame([(float((found**2).sum()),)], "squares double"), "squares", digits=4)


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pipeline(CountVectoriser(*STOP_WORDS), Tfidf()).fit_transform(documents(spark, sf_dir))


@query()
def svd_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(TruncatedSVD(10).fit_transform(_weighted(spark, sf_dir)), "value")


@query()
def lsi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest, in the space of ten singular vectors, to each passage of the benchmark table."""
    steps = Pipeline(CountVectoriser(*STOP_WORDS), Tfidf(), TruncatedSVD(10))
    found = written(to_arrays(steps.fit_transform(documents(spark, sf_dir)), 10).select(F.col("doc_id").alias("id"), "vec"), "lsi")
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    queries = to_arrays(steps.transform(asked), 10).select(F.col("doc_id").alias("id"), "vec")
    return _found(LinearScanIndex(measures.cosine_distance).index(found).search(queries, NEAREST))


@query("SELECT CAST(count(*) AS BIGINT) AS vectors, TRUE AS projected_alike FROM embeddings")
def svd_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decomposition of the embeddings, saved and loaded, projects every vector as before."""
    entries = vectors(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode("vec").alias("term_idx", "value"))
    path = f"{shared_dir(spark)}/svd-{spark.sparkContext.applicationId}"
    model = TruncatedSVD(10).fit(entries)
    model.save(path)
    a, b = model.transform(entries), TruncatedSVD.load(spark, path).transform(entries)
    both = a.join(b.withColumnRenamed("value", "other"), ["doc_id", "comp"], "full")
    close: Column = F.coalesce(F.abs(F.col("value") - F.col("other")) < 1e-9, F.lit(False))
    return both.agg(F.count_distinct("doc_id").alias("vectors"), F.bool_and(close).alias("projected_alike"))


#: Far fewer iterations and passes than the defaults (1000 and 500), but enough for each rule that ends them to be tried.
TOPICS, LDA = 8, {"iterations": 60, "transformation_passes": 60, "batch_size": 500}


def _lda(spark: SparkSession, sf_dir: str) -> tuple[LatentDirichletAllocation, DataFrame]:
    counts = written(CountVectoriser(*STOP_WORDS).fit_transform(documents(spark, sf_dir)), "counts")
    return LatentDirichletAllocation(TOPICS, **LDA), counts


@query()
def lda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts = _lda(spark, sf_dir)
    return rounded(model.fit(counts).components(spark), "prob")


@query()
def lda_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts = _lda(spark, sf_dir)
    return rounded(model.fit(counts).transform(counts), "prob")


@query(f"SELECT CAST(topic AS INTEGER) AS topic, 1.0::DOUBLE AS total FROM range({TOPICS}) t(topic)")
def lda_topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts = _lda(spark, sf_dir)
    return rounded(model.fit(counts).components(spark).groupBy("topic").agg(F.sum("prob").alias("total")), "total")


@query("WITH t AS (SELECT doc_id, len(regexp_extract_all(lower(text), '\\p{L}+')) AS n FROM documents) SELECT doc_id, 1.0::DOUBLE AS total FROM t WHERE n > 0")
def lda_mixture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(CountVectoriser().fit_transform(documents(spark, sf_dir)), "counts")
    mixtures = LatentDirichletAllocation(TOPICS, **LDA).fit_transform(counts)
    return rounded(mixtures.groupBy("doc_id").agg(F.sum("prob").alias("total")), "total")


@query()
def lda_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts = _lda(spark, sf_dir)
    return spark.createDataFrame([(model.fit(counts).perplexity(counts),)], "perplexity double")


BANDS = 97


@query(
    f"""WITH {_COUNTS}, {_IDF}, y AS (SELECT doc_id, term_idx, value * idf AS y FROM m JOIN i USING (term_idx))
    SELECT doc_id, CAST(term_idx % {BANDS} AS INTEGER) AS band, round(sum(y * (1 + term_idx % 7)), 6) + 0.0 AS value FROM y GROUP BY ALL"""
)
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse product of the weighted documents with a matrix of terms by bands."""
    weighted = written(Pipeline(CountVectoriser(), Tfidf()).fit_transform(documents(spark, sf_dir)), "weighted")
    bands = weighted.select("term_idx").distinct().select("term_idx", (F.col("term_idx") % BANDS).alias("band"), (1 + F.col("term_idx") % 7).cast("double").alias("value"))
    return rounded(sparse_matmul(weighted, bands, "term_idx", "doc_id", "band"), "value")
