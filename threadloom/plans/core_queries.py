"""Queries of the core operators and their SQL."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import aligned, places, sequences, text
from threadloom.nn import activations, initializers, layers, losses, optimizers
from threadloom.operators import cooccurrence, dataset, glove, metrics, tracker, vocabulary
from threadloom.plans.pipeline import TokenizationPipeline
from threadloom.session import materialise, spread, table
from threadloom.sources.store import mapped
from threadloom.subword import words as W
from threadloom.subword.models import BPE, WordPiece

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _by_place(rows: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    return rows.select(key, F.posexplode(tokens).alias("pos", "token"))


def _places(sql_tokens: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"""WITH t AS (SELECT {key}, {sql_tokens} AS ts FROM {source})
        SELECT {key}, (unnest(range(len(ts)::BIGINT)))::INT AS pos, unnest(ts) AS token FROM t WHERE ts IS NOT NULL"""


# Unicode white space for engines whose \s is ASCII, and the four separators.
_W = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_W2 = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_CLEAN = f"regexp_replace(regexp_replace(text, '^[{_W}]+|[{_W}]+$', '', 'g'), '([{_W}])[{_W}]+', '\\1', 'g')"


def _gpt2_sql(expr: str) -> str:
    marked = f"regexp_replace({expr}, '([{_W2}])([{_W2}][^{_W2}])', '\\1' || chr(57344) || '\\2', 'g')"
    pattern = f"'''(?:[sdmt]|ll|ve|re)| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_W2}\\p{{L}}\\p{{N}}\\x{{E000}}]+|[{_W2}]+|\\x{{E000}}'"
    return f"list_filter(regexp_extract_all({marked}, {pattern}), lambda t: t <> chr(57344))"


# ------------------------------------------------------------- normalisation

@query("norm_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def norm_lower(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("text", text.lower(F.col("text")))


_SPACED = "concat(chr(32), chr(9), replace(text, ' ', '  '), chr(10))"


@query("norm_whitespace", f"SELECT doc_id, {_CLEAN} AS text FROM (SELECT doc_id, {_SPACED} AS text FROM documents WHERE text IS NOT NULL)")
def norm_whitespace(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").withColumn("text", F.concat(F.lit(" \t"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n")))
    return rows.withColumn("text", text.collapse_blanks(F.col("text")))


_BLANKS_END = f"([{_W2}])([\\t\\x{{0B}}\\x{{0C}} \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}][^{_W2}])"


def _gpt4_sql(expr: str, branches: list[str]) -> str:
    """Tokens of a pattern with these word branches, for an engine without lookahead.

    A sign of its own parts the last blank of a run from those before it where something
    visible follows, unless that blank is a line break, which its own branch takes first.
    """
    marked = f"regexp_replace({expr}, '{_BLANKS_END}', '\\1' || chr(57344) || '\\2', 'g')"
    pattern = "|".join([*branches, f"[{_W2}]+", "\\x{E000}"]).replace("'", "''")
    return f"list_filter(regexp_extract_all({marked}, '{pattern}'), lambda t: t <> chr(57344))"


_SEEN = f"[^{_W2}\\p{{L}}\\p{{N}}\\x{{E000}}]"
_LEAD = "[^\\r\\n\\p{L}\\p{N}\\x{E000}]?"
_BIG, _SMALL = "[\\p{Lu}\\p{Lt}\\p{Lm}\\p{Lo}\\p{M}]", "[\\p{Ll}\\p{Lm}\\p{Lo}\\p{M}]"
_TAIL = "(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
_GPT4 = ["'(?i:[sdmt]|ll|ve|re)", f"{_LEAD}\\p{{L}}+", "\\p{N}{1,3}", f" ?{_SEEN}+[\\r\\n]*", f"[{_W2}]*[\\r\\n]"]
_GPT4O_END = ["\\p{N}{1,3}", f" ?{_SEEN}+[\\r\\n/]*", f"[{_W2}]*[\\r\\n]+"]
_GPT4O = [f"{_LEAD}{_BIG}*{_SMALL}+{_TAIL}", f"{_LEAD}{_BIG}+{_SMALL}*{_TAIL}", *_GPT4O_END]
_BROKEN = "\\\n        "
_GPT4O_LITERAL = [_BROKEN.join([f"{_LEAD}{_BIG}*", f"{_SMALL}+", _TAIL]), _BROKEN.join([f"{_LEAD}{_BIG}+", f"{_SMALL}*", _TAIL]), *_GPT4O_END, "\\p{L}+"]


def _form(form: str):
    return lambda spark, sf_dir: _docs(spark, sf_dir).withColumn("text", text.unicode_form(F.col("text"), form))


query("norm_nfc", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")(_form("NFC"))
for _name in ("NFD", "NFKC", "NFKD"):
    query(f"norm_{_name.lower()}")(_form(_name))


@query("norm_marks", r"SELECT doc_id, regexp_replace(text, '\p{Mn}', '', 'g') AS text FROM documents")
def norm_marks(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("text", text.strip_marks(F.col("text")))


@query("norm_accents_composed", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def norm_accents_composed(spark, sf_dir):
    """Without marks of any kind, what remains composed again."""
    bare = F.regexp_replace(text.unicode_form(F.col("text"), "NFD"), r"\p{M}", "")
    return _docs(spark, sf_dir).withColumn("text", text.unicode_form(bare, "NFC"))


@query("norm_accents")
def norm_accents(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("text", text.strip_marks(text.unicode_form(F.col("text"), "NFD")))


@query("norm_forms", "SELECT doc_id, nfc_normalize(text) AS nfc, nfc_normalize(text) AS nfd_composed, true AS nfkd_is_nfd_of_nfkc FROM documents WHERE text IS NOT NULL")
def norm_forms(spark, sf_dir):
    """The four forms of every text against each other: NFC of NFD is NFC, NFD of NFKC is NFKD."""
    form = text.unicode_form
    t = F.col("text")
    same = form(form(t, "NFKC"), "NFD") == form(t, "NFKD")
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", form(t, "NFC").alias("nfc"), form(form(t, "NFD"), "NFC").alias("nfd_composed"), same.alias("nfkd_is_nfd_of_nfkc"))


@query("norm_replace", "SELECT doc_id, replace(text, 'token', 'TOKEN') AS text FROM documents")
def norm_replace(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("text", text.replace_literal(F.col("text"), "token", "TOKEN"))


@query("norm_sequence", f"SELECT doc_id, replace(lower({_CLEAN}), 'the', '_') AS text FROM documents")
def norm_sequence(spark, sf_dir):
    clean = text.replace_literal(text.lower(text.collapse_blanks(F.col("text"))), "the", "_")
    return _docs(spark, sf_dir).withColumn("text", clean)


@query("norm_aligned")
def norm_aligned(spark, sf_dir):
    steps = [aligned.collapse_blanks, aligned.unicode_form("NFKD"), aligned.strip_marks, aligned.lower, aligned.replace_literal("ss", "ß")]
    return _docs(spark, sf_dir).select("doc_id", aligned.chain(F.col("text"), *steps).alias("m")).select("doc_id", "m.text", "m.alignment")


@query("alignment_init", "SELECT doc_id, text AS original, range(length(text)) AS alignment FROM documents")
def alignment_init(spark, sf_dir):
    return mapped(_docs(spark, sf_dir)).select("doc_id", "original", F.col("alignment").cast("array<bigint>").alias("alignment"))


@query(
    "span_lookup",
    """SELECT string_id, CASE WHEN 5 <= len(alignment) THEN alignment[3] END AS o_start, CASE WHEN 5 <= len(alignment) THEN alignment[5] + 1 END AS o_end
       FROM mapped_string""",
)
def span_lookup(spark, sf_dir):
    s = text.span(F.col("alignment"), F.lit(2), F.lit(5))
    return table(spark, sf_dir, "mapped_string").select("string_id", s["start"].alias("o_start"), s["end"].alias("o_end"))


# ---------------------------------------------------------- pre-tokenisation

@query("pretok_whitespace", _places(f"list_filter(regexp_split_to_array(text, '[{_W2}]+'), lambda t: t <> '')"))
def pretok_whitespace(spark, sf_dir):
    return _by_place(_docs(spark, sf_dir), text.split_blanks(F.col("text")))


@query("pretok_punct", _places("regexp_extract_all(text, '[[:punct:]]|[^[:punct:]]+')"))
def pretok_punct(spark, sf_dir):
    return _by_place(_docs(spark, sf_dir), text.split_punctuation(F.col("text")))


@query("pretok_gpt2", _places(_gpt2_sql("text")))
def pretok_gpt2(spark, sf_dir):
    return _by_place(_docs(spark, sf_dir), text.split_keep(F.col("text"), text.GPT2))


@query("pretok_drop_matches", _places(r"list_filter(regexp_split_to_array(text, '\p{N}+'), lambda t: t <> '')"))
def pretok_drop_matches(spark, sf_dir):
    return _by_place(_docs(spark, sf_dir), text.split_drop(F.col("text"), r"\p{N}+"))


def _pattern(name: str):
    return lambda spark, sf_dir: _by_place(_docs(spark, sf_dir), text.split_keep(F.col("text"), text.PATTERNS[name]))


for _name, _branches in (("gpt4", _GPT4), ("gpt4o", _GPT4O), ("gpt4o_literal", _GPT4O_LITERAL)):
    query(f"pretok_{_name}", _places(_gpt4_sql("text", _branches)))(_pattern(_name))
query("pretok_boundless")(_pattern("boundless"))


def _placed_sql(sql_tokens: str, where: str = "") -> str:
    return f"""WITH t AS ({_places(sql_tokens)}), p AS (SELECT doc_id, pos, token,
        (sum(length(token)) OVER (PARTITION BY doc_id ORDER BY pos) - length(token))::INT AS "start" FROM t)
        SELECT doc_id, token, "start", ("start" + length(token))::INT AS "end" FROM p {where}"""


def _placed(rows: DataFrame, tokens: Column) -> DataFrame:
    return rows.select("doc_id", F.explode(tokens).alias("t")).select("doc_id", "t.token", "t.start", "t.end")


@query("pretok_places", _placed_sql(_gpt2_sql("text")))
def pretok_places(spark, sf_dir):
    return _placed(_docs(spark, sf_dir), places.placed(text.split_keep(F.col("text"), text.GPT2)))


@query("pretok_whitespace_places", _placed_sql(f"regexp_extract_all(text, '[{_W2}]+|[^{_W2}]+')", f"WHERE NOT regexp_full_match(token, '[{_W2}]+')"))
def pretok_whitespace_places(spark, sf_dir):
    words = places.placed_where(text.split_keep(F.col("text"), r"\s+"), lambda t: ~t.rlike(r"(?U)^\s"))
    return _placed(_docs(spark, sf_dir), words)


@query(
    "pretok_punct_places",
    _placed_sql("regexp_extract_all(text, '[[:punct:]]|[^[:punct:]]+')"),
)
def pretok_punct_places(spark, sf_dir):
    return _placed(_docs(spark, sf_dir), places.placed(text.split_punctuation(F.col("text"))))


@query(
    "pretok_bytelevel_places",
    """WITH c AS (SELECT doc_id, unnest(range(length(text))) AS k, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents WHERE text <> ''),
    b AS (SELECT doc_id, k, unnest(range(octet_length(encode(c)))) AS j FROM c)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1)::INT AS pos, k::INT AS place FROM b""",
)
def pretok_bytelevel_places(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(places.byte_places(F.col("text"))).alias("pos", "place"))

_LETTERS = "[" + ", ".join(f"chr({ord(c)})" for c in text.byte_alphabet()) + "]"


@query(
    "pretok_bytelevel",
    f"""SELECT doc_id, CASE WHEN text = '' THEN '' ELSE list_aggregate(list_transform(regexp_extract_all(hex(encode(text)), '..'),
        lambda h: letters[('0x' || h)::INT + 1]), 'string_agg', '') END AS text FROM documents, (SELECT {_LETTERS} AS letters)""",
)
def pretok_bytelevel(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("text", text.byte_level(F.col("text")))


@query(
    "pretok_sequence",
    _places(f"flatten(list_transform(list_filter(regexp_split_to_array(text, '[{_W2}]+'), lambda t: t <> ''), lambda t: regexp_extract_all(t, '[[:punct:]]|[^[:punct:]]+')))"),
)
def pretok_sequence(spark, sf_dir):
    return _by_place(_docs(spark, sf_dir), text.in_sequence(F.col("text"), text.split_blanks, text.split_punctuation))


# ----------------------------------------------------------------- vocabulary

def _words(spark, sf_dir) -> DataFrame:
    return W.word_counts(_docs(spark, sf_dir).select(text.split_blanks(text.lower(F.col("text"))).alias("tokens")))


_WORDS = f"""words AS (SELECT word, count(*) AS freq FROM (
    SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[{_W2}]+'), lambda t: t <> '')) AS word FROM documents) GROUP BY word)"""
_SPECIAL = ", ".join(f"({k}, '{t}', '{n}')" for k, t, n in vocabulary.special_rows())
_VOCAB = f"""special AS (SELECT * FROM (VALUES {_SPECIAL}) v(id, token, special_name)),
fresh AS (SELECT word FROM words WHERE word NOT IN (SELECT token FROM special)),
vocab AS (SELECT id, token, special_name FROM special UNION ALL SELECT (6 + row_number() OVER (ORDER BY word))::INT, word, NULL FROM fresh)"""


def _vocab(spark, sf_dir) -> DataFrame:
    return vocabulary.add(vocabulary.create(spark), _words(spark, sf_dir).withColumnRenamed("word", "token"))


@query("vocab_build", f"WITH {_WORDS}, {_VOCAB} SELECT * FROM vocab")
def vocab_build(spark, sf_dir):
    return _vocab(spark, sf_dir)


@query(
    "vocab_encode",
    f"""SELECT t.doc_id, t.pos, coalesce(v.id, 0) AS id FROM ({_places(_gpt2_sql("lower(text)"))}) t LEFT JOIN vocabulary v ON t.token = v.token""",
)
def vocab_encode(spark, sf_dir):
    rows = _by_place(_docs(spark, sf_dir), text.split_keep(text.lower(F.col("text")), text.GPT2))
    return vocabulary.encode(rows, table(spark, sf_dir, "vocabulary")).select("doc_id", "pos", "id")


@query(
    "vocab_decode",
    """SELECT sentence_id, pos, token FROM (SELECT sentence_id, unnest(range(len(tokens)::BIGINT))::INT AS pos, unnest(tokens) AS id FROM processed) LEFT JOIN vocabulary USING (id)""",
)
def vocab_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "processed").select("sentence_id", F.posexplode("tokens").alias("pos", "id"))
    return vocabulary.decode(rows, table(spark, sf_dir, "vocabulary")).select("sentence_id", "pos", "token")


@query(
    "vocab_decode_arrays",
    """WITH v AS (SELECT list(token ORDER BY id) AS v FROM (SELECT r.id, token FROM range((SELECT max(id) + 1 FROM vocabulary)) r(id) LEFT JOIN vocabulary USING (id)))
       SELECT sentence_id, len(tokens)::INT AS n, array_to_string(list_transform(tokens, lambda t: coalesce(CASE WHEN t >= 0 THEN v[t + 1] END, '?')), ' ') AS tokens FROM processed, v WHERE tokens IS NOT NULL""",
)
def vocab_decode_arrays(spark, sf_dir):
    known = vocabulary.token_list(table(spark, sf_dir, "vocabulary"))
    rows = table(spark, sf_dir, "processed").where("tokens IS NOT NULL").withColumn("t", vocabulary.decode_arrays(F.col("tokens"), known))
    return rows.select("sentence_id", F.size("t").alias("n"), F.array_join("t", " ", "?").alias("tokens"))


@query("vocab_contains", f"WITH {_WORDS} SELECT word AS token, freq FROM words WHERE word IN (SELECT token FROM vocabulary)")
def vocab_contains(spark, sf_dir):
    return vocabulary.contains(_words(spark, sf_dir).withColumnRenamed("word", "token"), table(spark, sf_dir, "vocabulary"))


@query(
    "vocab_add_missing",
    f"""WITH {_WORDS}, fresh AS (SELECT word FROM words WHERE word NOT IN (SELECT token FROM vocabulary WHERE token IS NOT NULL))
        SELECT id, token, special_name FROM vocabulary UNION ALL
        SELECT ((SELECT max(id) FROM vocabulary) + row_number() OVER (ORDER BY word))::INT, word, NULL FROM fresh""",
)
def vocab_add_missing(spark, sf_dir):
    return vocabulary.add(table(spark, sf_dir, "vocabulary"), _words(spark, sf_dir).withColumnRenamed("word", "token"))


# -------------------------------------------------------------------- subword

@query("word_count", f"WITH {_WORDS} SELECT word, freq FROM words")
def word_count(spark, sf_dir):
    return _words(spark, sf_dir)


@query("merge_budget", f"WITH {_WORDS} SELECT floor(count(*) * 0.35)::INT AS merges FROM words")
def merge_budget(spark, sf_dir):
    return spark.createDataFrame([(W.merge_budget(_words(spark, sf_dir), 0.35),)], "merges int")


@query("alphabet", f"WITH {_WORDS} SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS char FROM words")
def alphabet(spark, sf_dir):
    return W.alphabet(_words(spark, sf_dir))


_BPE_PAIRS = f"""{_WORDS}, s AS (SELECT list_append(regexp_extract_all(word, '(?s).'), '</s>') AS s, freq FROM words),
p AS (SELECT unnest(list_zip(s[:-2], s[2:])) AS p, freq FROM s), pairs AS (SELECT p[1] AS l, p[2] AS r, sum(freq)::BIGINT AS n FROM p GROUP BY ALL)"""
_WP_PAIRS = f"""{_WORDS}, s AS (SELECT list_prepend('</b>', regexp_extract_all(word, '(?s).')) AS s, freq FROM words),
p AS (SELECT unnest(list_zip(s[:-2], s[2:])) AS p, freq FROM s), pairs AS (SELECT p[1] AS l, p[2] AS r, sum(freq)::BIGINT AS n FROM p GROUP BY ALL),
single AS (SELECT c, sum(freq) AS n FROM (SELECT unnest(s) AS c, freq FROM s) GROUP BY c),
scored AS (SELECT l, r, p.n, p.n::DOUBLE / (a.n * b.n)::DOUBLE AS score FROM pairs p JOIN single a ON a.c = l JOIN single b ON b.c = r)"""


@query("bpe_pair_counts", f"WITH {_BPE_PAIRS} SELECT l, r, n FROM pairs")
def bpe_pair_counts(spark, sf_dir):
    return W.pair_counts(_words(spark, sf_dir))


@query("bpe_first_merge", f"WITH {_BPE_PAIRS} SELECT l, r, n FROM pairs ORDER BY n DESC, l, r LIMIT 1")
def bpe_first_merge(spark, sf_dir):
    return W.best_pair(W.pair_counts(_words(spark, sf_dir)), "n")


@query("wp_pair_scores", f"WITH {_WP_PAIRS} SELECT l, r, n, score FROM scored")
def wp_pair_scores(spark, sf_dir):
    return W.piece_scores(_words(spark, sf_dir))


@query("wp_first_merge", f"WITH {_WP_PAIRS} SELECT l, r, score FROM scored ORDER BY score DESC, l, r LIMIT 1")
def wp_first_merge(spark, sf_dir):
    return W.best_pair(W.piece_scores(_words(spark, sf_dir)), "score")


#: A fixed merge list, so that both engines replay the same one.
MERGES = [
    ("t", "h"), ("th", "e"), ("i", "n"), ("e", "r"), ("s", "</s>"), ("the", "</s>"), ("e", "</s>"), ("o", "n"), ("a", "t"), ("in", "g"),
    ("ing", "</s>"), ("e", "n"), ("r", "o"), ("t", "o"), ("l", "o"), ("s", "t"), ("a", "n"), ("n", "</s>"), ("lo", "s"), ("los", "s</s>"), ("a", "r"), ("o", "r"), ("or", "</s>"),
]


def _fixed_bpe() -> BPE:
    letters = [*string.ascii_lowercase, W.BPE_END]
    return BPE(list(dict.fromkeys([*vocabulary.SPECIAL.values(), *letters, *(a + b for a, b in MERGES)])), MERGES)


def _replay_sql() -> str:
    o, c = "chr(57345)", "chr(57346)"
    acc = f"regexp_replace(word, '(?s)(.)', {o} || '\\1' || {c}, 'g') || {o} || '</s>' || {c}"
    for a, b in MERGES:
        acc = f"replace({acc}, {o} || '{a}' || {c} || {o} || '{b}' || {c}, {o} || '{a}{b}' || {c})"
    return f"list_filter(string_split(replace({acc}, {o}, ''), {c}), lambda s: s <> '')"


@query("bpe_tokenize", f"WITH {_WORDS} SELECT word, array_to_string({_replay_sql()}, ' ') AS subtokens FROM words")
def bpe_tokenize(spark, sf_dir):
    return _words(spark, sf_dir).select("word", F.array_join(_fixed_bpe().replay(F.col("word")), " ").alias("subtokens"))


@query(
    "bpe_places",
    f"""WITH t AS ({_placed_sql(f"regexp_extract_all(text, '[{_W2}]+|[^{_W2}]+')", f"WHERE NOT regexp_full_match(token, '[{_W2}]+')")}),
    w AS (SELECT doc_id, "start" AS s, {_replay_sql().replace("word", "token")} AS ts FROM t),
    p AS (SELECT doc_id, s, (unnest(range(len(ts)::BIGINT)))::INT AS pos, unnest(ts) AS token FROM w),
    q AS (SELECT *, length(regexp_replace(token, '</s>$', '')) AS n FROM p)
    SELECT doc_id, token, (s + sum(n) OVER (PARTITION BY doc_id, s ORDER BY pos) - n)::INT AS "start", (s + sum(n) OVER (PARTITION BY doc_id, s ORDER BY pos))::INT AS "end" FROM q""",
)
def bpe_places(spark, sf_dir):
    tokens = text.split_keep(F.col("text"), r"\s+")
    return places.subtoken_rows(_docs(spark, sf_dir), "doc_id", tokens, lambda t: ~t.rlike(r"(?U)^\s"), _fixed_bpe())


_BPE_IDS = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in _fixed_bpe().vocabulary) + "]"


@query(
    "bpe_encode",
    f"WITH {_WORDS}, t AS (SELECT word, {_replay_sql()} AS ts FROM words), v AS (SELECT {_BPE_IDS} AS v) "
    "SELECT word, array_to_string(list_transform(ts, lambda x: coalesce(nullif(list_position(v, x), 0) - 1, 0)), ' ') AS ids FROM t, v",
)
def bpe_encode(spark, sf_dir):
    ids = _fixed_bpe().encode(F.array("word"))
    return _words(spark, sf_dir).select("word", F.array_join(ids.cast("array<string>"), " ").alias("ids"))


@query("bpe_train")
def bpe_train(spark, sf_dir):
    model = BPE.fit(_words(spark, sf_dir))
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(model.merges)], "rank int, l string, r string")


@query("wp_train")
def wp_train(spark, sf_dir):
    return WordPiece.fit(_words(spark, sf_dir)).vocabulary_frame(spark)


@query("wp_encode")
def wp_encode(spark, sf_dir):
    words = materialise(_words(spark, sf_dir))
    return words.select("word", WordPiece.fit(words).encode(F.array("word")).alias("ids"))


@query("wp_tokenize")
def wp_tokenize(spark, sf_dir):
    words = materialise(_words(spark, sf_dir))
    model = WordPiece.fit(words)
    return words.select("word", F.get(model.tokenize(F.array("word")), F.lit(0))["subtokens"].alias("subtokens"))


@query("bpe_dropout_roundtrip", f"WITH {_WORDS} SELECT word, word || '</s>' AS joined FROM words")
def bpe_dropout_roundtrip(spark, sf_dir):
    parts = F.get(_fixed_bpe().tokenize(F.array("word"), key=F.col("word"), dropout=0.3, seed=7), F.lit(0))["subtokens"]
    return _words(spark, sf_dir).select("word", F.array_join(parts, "").alias("joined"))


@query("bpe_dropout")
def bpe_dropout(spark, sf_dir):
    """The parts of every word of the corpus by the fitted model with dropout."""
    words = materialise(_words(spark, sf_dir))
    return words.select("word", F.get(BPE.fit(words).tokenize(F.array("word"), key=F.col("word"), dropout=0.3, seed=7), F.lit(0))["subtokens"].alias("subtokens"))


# ------------------------------------------------------------ post-processing

def _processed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "processed").select("sentence_id", "tokens", "attention_mask")


def _text(c) -> Column:
    return F.array_join(c.cast("array<string>"), " ")


def _post(name: str, expr, sql: str) -> None:
    query(name, f"SELECT sentence_id, array_to_string({sql}, ' ') AS ids FROM processed")(lambda spark, sf_dir: _processed(spark, sf_dir).select("sentence_id", _text(expr(F.col("tokens"))).alias("ids")))


_post("post_truncate_right", lambda t: sequences.truncate(t, 6), "tokens[:6]")
_post("post_truncate_left", lambda t: sequences.truncate(t, 6, "left"), "tokens[-6:]")
_post("post_pad_right", lambda t: sequences.pad(t, 10, 1), "list_concat(tokens, list_transform(range(greatest(10 - len(tokens), 0)), lambda x: 1))")
_post("post_pad_left", lambda t: sequences.pad(t, 10, 1, "left"), "list_concat(list_transform(range(greatest(10 - len(tokens), 0)), lambda x: 1), tokens)")
_IDS = {t: k for k, t in enumerate(vocabulary.SPECIAL.values())}
_ITEMS = ["<BOS>", "$", "<EOS>"]


@query("post_special", "SELECT sentence_id, array_to_string(list_concat([3], tokens, [4]), ' ') AS ids, array_to_string(list_concat([0], attention_mask, [0]), ' ') AS mask FROM processed")
def post_special(spark, sf_dir):
    ids, mask = sequences.template(F.col("tokens"), F.col("attention_mask"), _ITEMS, _IDS, set(_IDS))
    return _processed(spark, sf_dir).select("sentence_id", _text(ids).alias("ids"), _text(mask).alias("mask"))


@query(
    "post_sequence",
    """WITH t AS (SELECT sentence_id, list_concat([3], tokens[:6], [4]) AS x, list_concat([0], attention_mask[:6], [0]) AS m FROM processed)
       SELECT sentence_id, array_to_string(list_concat(x, list_transform(range(greatest(10 - len(x), 0)), lambda i: 1)), ' ') AS ids,
              array_to_string(list_concat(m, list_transform(range(greatest(10 - len(m), 0)), lambda i: 0)), ' ') AS mask FROM t""",
)
def post_sequence(spark, sf_dir):
    ids, mask = sequences.template(sequences.truncate(F.col("tokens"), 6), sequences.truncate(F.col("attention_mask"), 6), _ITEMS, _IDS, set(_IDS))
    return _processed(spark, sf_dir).select("sentence_id", _text(sequences.pad(ids, 10, 1)).alias("ids"), _text(sequences.pad(mask, 10, 0)).alias("mask"))


@query(
    "post_flatten",
    """WITH t AS (SELECT doc_id, list(tokens ORDER BY sentence_id) AS x FROM processed WHERE doc_id IS NOT NULL AND tokens IS NOT NULL GROUP BY doc_id)
       SELECT doc_id, array_to_string(flatten(x), ' ') AS ids, len(flatten(x))::INT AS n_mask FROM t""",
)
def post_flatten(spark, sf_dir):
    rows = table(spark, sf_dir, "processed").where("doc_id IS NOT NULL AND tokens IS NOT NULL")
    nested = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "tokens"))).alias("x"))
    flat = sequences.flatten(F.transform("x", lambda s: s["tokens"]))
    return nested.select("doc_id", _text(flat).alias("ids"), F.size(sequences.ones(flat)).alias("n_mask"))


#: Ids kept of a text: the longest document of sf0.1 has 1,670.
ENCODED_LENGTH = 2048


@query("pipeline_encode")
def pipeline_encode(spark, sf_dir):
    docs = spread(_docs(spark, sf_dir), "doc_id")
    return TokenizationPipeline(pattern="gpt4o").fit(docs).encode(docs, ENCODED_LENGTH).select("doc_id", "ids", "attention_mask")


# -------------------------------------------------- co-occurrence, embeddings

def _cooc_sql(weight: str) -> str:
    return f"""WITH t AS (SELECT sentence_id, unnest(range(len(tokens)::BIGINT)) AS p, unnest(tokens) AS tok FROM processed),
        w AS (SELECT a.tok AS x, b.tok AS y, {weight} AS v FROM t a JOIN t b ON a.sentence_id = b.sentence_id AND b.p BETWEEN a.p + 1 AND a.p + 5),
        u AS (SELECT x AS i, y AS j, v FROM w UNION ALL SELECT y, x, v FROM w)
        SELECT i, j, round(sum(v), 6) AS value FROM u GROUP BY i, j"""


@query("cooc_weighted", _cooc_sql("1.0::DOUBLE / (b.p - a.p)"))
def cooc_weighted(spark, sf_dir):
    return cooccurrence.cooccurrence(_processed(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("cooc_unweighted", _cooc_sql("1.0::DOUBLE"))
def cooc_unweighted(spark, sf_dir):
    return cooccurrence.cooccurrence(_processed(spark, sf_dir), weighted=False).withColumn("value", F.round("value", 6))


@query("cooc_shuffle", "SELECT i, j, CASE WHEN NOT isnan(value) THEN value END AS value FROM cooccurrence")
def cooc_shuffle(spark, sf_dir):
    """All records in another order; NaN values, which equal nothing, are shown as NULL."""
    rows = table(spark, sf_dir, "cooccurrence").select("i", "j", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    return cooccurrence.shuffle_rows(rows, seed=3)


@query("cooc_count", "SELECT count(*) AS n FROM cooccurrence WHERE i >= 0 AND j >= 0")
def cooc_count(spark, sf_dir):
    n = cooccurrence.count(table(spark, sf_dir, "cooccurrence").where("i >= 0 AND j >= 0"))
    return spark.createDataFrame([(n,)], "n bigint")


@query("cooc_iterate", "SELECT count(*) AS n, sum(i)::BIGINT AS sum_i, sum(j)::BIGINT AS sum_j FROM cooccurrence WHERE i >= 0 AND j >= 0")
def cooc_iterate(spark, sf_dir):
    """Sums over all records as the driver receives them batch by batch."""
    n = i = j = 0
    for block in cooccurrence.batches(table(spark, sf_dir, "cooccurrence").where("i >= 0 AND j >= 0")):
        n, i, j = n + len(block), i + int(block["i"].sum(dtype="int64")), j + int(block["j"].sum(dtype="int64"))
    return spark.createDataFrame([(n, i, j)], "n bigint, sum_i bigint, sum_j bigint")


@query("cooc_pack", "SELECT i, j, (i::BIGINT << 32) | j::BIGINT AS code, i AS i_back, j AS j_back FROM cooccurrence WHERE i >= 0 AND j >= 0")
def cooc_pack(spark, sf_dir):
    rows = table(spark, sf_dir, "cooccurrence").where("i >= 0 AND j >= 0").withColumn("code", cooccurrence.pack(F.col("i"), F.col("j")))
    i, j = cooccurrence.unpack(F.col("code"))
    return rows.select("i", "j", "code", i.alias("i_back"), j.alias("j_back"))


_GOOD = "FROM cooccurrence WHERE value > 0 AND NOT isnan(value) AND i >= 0 AND j >= 0"


@query("glove_weight", f"SELECT i, j, round(CASE WHEN value < 2 THEN pow(value / 2, 0.75) ELSE 1 END, 6) AS f {_GOOD}")
def glove_weight(spark, sf_dir):
    rows = table(spark, sf_dir, "cooccurrence").where("value > 0 AND NOT isnan(value) AND i >= 0 AND j >= 0")
    return rows.select("i", "j", F.round(glove.weight(F.col("value"), 2.0), 6).alias("f"))


def _formula_params(vocab: DataFrame) -> DataFrame:
    t = F.col("id")
    vec = lambda k: F.array(*[F.sin(t * 4 + c + k) / 8 for c in range(4)])
    ones = F.array(*[F.lit(1.0)] * 4)
    return vocab.select(t.alias("token_id"), vec(0).alias("w"), vec(1).alias("wc"), (F.sin(t * 1.0) / 8).alias("b"), (F.cos(t * 1.0) / 8).alias("bc"), ones.alias("gw"), ones.alias("gwc"), F.lit(1.0).alias("gb"), F.lit(1.0).alias("gbc"))


_P = "SELECT id AS token_id, " + ", ".join(f"sin(id * 4 + {c}) / 8 AS w{c}, sin(id * 4 + {c} + 1) / 8 AS c{c}" for c in range(4)) + ", sin(id * 1.0) / 8 AS b, cos(id * 1.0) / 8 AS bc FROM vocabulary"
_DIFF = " + ".join(f"p.w{c} * q.c{c}" for c in range(4)) + " + p.b + q.bc - ln(value)"
_RESIDUAL = f"""WITH params AS ({_P}), rows AS (SELECT i, j, value, CASE WHEN value < 100 THEN pow(value / 100, 0.75) ELSE 1 END AS f, {_DIFF} AS diff,
    {", ".join(f"q.c{c} AS c{c}, p.w{c} AS w{c}" for c in range(4))} FROM cooccurrence JOIN params p ON i = p.token_id JOIN params q ON j = q.token_id WHERE value > 0 AND NOT isnan(value))"""


@query("glove_one_step_loss", _RESIDUAL + " SELECT i, round(sum(f * diff * diff), 5) AS loss, count(*) AS n FROM rows GROUP BY i")
def glove_one_step_loss(spark, sf_dir):
    rows = glove.residuals(table(spark, sf_dir, "cooccurrence").select("i", "j", "value"), _formula_params(table(spark, sf_dir, "vocabulary")))
    return rows.groupBy("i").agg(F.round(F.sum("loss"), 5).alias("loss"), F.count(F.lit(1)).alias("n"))


@query(
    "glove_group_grad",
    _RESIDUAL + ", g AS (" + " UNION ALL ".join(f"SELECT i, {c} AS pos, 2 * f * diff * c{c} AS g FROM rows" for c in range(4)) + " UNION ALL SELECT i, -1, 2 * f * diff FROM rows)"
    " SELECT i AS index, pos, round(sum(g), 5) AS total, round(sum(g * g), 5) AS total_sq FROM g GROUP BY i, pos",
)
def glove_group_grad(spark, sf_dir):
    rows = glove.residuals(table(spark, sf_dir, "cooccurrence").select("i", "j", "value"), _formula_params(table(spark, sf_dir, "vocabulary")))
    rows = rows.select("i", F.transform("wc", lambda x: x * F.col("g")).alias("v"), "g")
    return glove.grouped_sums(rows, "i", "v", "g").withColumns({c: F.round(c, 5) for c in ("total", "total_sq")})


def _glove_sides() -> str:
    """SQL of the sums of both sides of a step, all dimensions and the bias."""

    def side(key: str, index: str, other: str, name: str) -> str:
        grads = [(f"{k}", f"2 * f * diff * {other}{k}") for k in range(4)] + [("b", "2 * f * diff")]
        sums = ", ".join(f"sum({g}) AS t{k}, sum(({g}) * ({g})) AS q{k}" for k, g in grads)
        return f"{name} AS (SELECT {index} AS {key}, {sums} FROM rows GROUP BY {index})"

    return ", " + side("ti", "i", "c", "si") + ", " + side("tj", "j", "w", "sj")


def _glove_moved() -> str:
    out = []
    for value, t, p, name, acc in [(f"w{k}", f"t{k}", "si", f"w{k}", f"gw{k}") for k in range(4)] + [("b", "tb", "si", "b", "gb")] + [(f"c{k}", f"t{k}", "sj", f"wc{k}", f"gwc{k}") for k in range(4)] + [("bc", "tb", "sj", "bc", "gbc")]:
        q = f"{p}.q{t[1:]}"
        out.append(f"round(CASE WHEN {p}.{t} IS NULL THEN {value} ELSE {value} - 0.05 * {p}.{t} / sqrt(1 + {q}) END, 5) AS {name}, round(1 + coalesce({q}, 0), 4) AS {acc}")
    return ", ".join(out)


@query("glove_step", _RESIDUAL + _glove_sides() + f" SELECT token_id, {_glove_moved()} FROM params LEFT JOIN si ON token_id = ti LEFT JOIN sj ON token_id = tj")
def glove_step(spark, sf_dir):
    """All parameters and accumulators after one step, both sides."""
    new = glove.step(table(spark, sf_dir, "cooccurrence").select("i", "j", "value"), _formula_params(table(spark, sf_dir, "vocabulary")))
    cells = [F.round(F.get(c, F.lit(k)), d).alias(f"{c}{k}") for c, d in (("w", 5), ("gw", 4), ("wc", 5), ("gwc", 4)) for k in range(4)]
    return new.select("token_id", *cells, *[F.round(c, d).alias(c) for c, d in (("b", 5), ("bc", 5), ("gb", 4), ("gbc", 4))])


@query("glove_train")
def glove_train(spark, sf_dir):
    model = glove.GloVe(4000, dimensions=8, seed=1)
    records = materialise(cooccurrence.cooccurrence(_processed(spark, sf_dir)))
    history = model.train(records, epochs=5)
    return spark.createDataFrame(list(enumerate(map(float, history))), "epoch int, loss double")


# ------------------------------------------------------------ neural networks

_X = "((event_id * 37) % 200 - 100) / 10.0::DOUBLE"
_SP = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_SG = "(1 / (1 + exp(-{x})))"
_ACT = {
    "relu": ("greatest({x}, 0)", "CASE WHEN {x} <= 0 THEN 0 ELSE 1 END"),
    "leaky_relu": ("CASE WHEN {x} > 0 THEN {x} ELSE 0.01 * {x} END", "CASE WHEN {x} <= 0 THEN 0.01 ELSE 1 END"),
    "sigmoid": (_SG, f"{_SG} * (1 - {_SG})"),
    "elu": ("CASE WHEN {x} > 0 THEN {x} ELSE exp(least({x}, 0)) - 1 END", "CASE WHEN {x} > 0 THEN 1 ELSE exp(least({x}, 0)) END"),
    "prelu": ("CASE WHEN {x} < 0 THEN 0.01 * {x} ELSE {x} END", "CASE WHEN {x} < 0 THEN 0.01 ELSE 1 END"),
    "tanh": ("tanh({x})", "1 - tanh({x}) * tanh({x})"),
    "sin": ("sin({x})", "cos({x})"),
    "identity": ("{x}", "1"),
    "softplus": (_SP, _SG),
    "mish": (f"{{x}} * tanh({_SP})", f"tanh({_SP}) + {{x}} * {_SG} * (1 - tanh({_SP}) * tanh({_SP}))"),
    "relu_clip": ("least(greatest({x}, 0), 8)", "CASE WHEN {x} <= 0 OR {x} >= 8 THEN 0 ELSE 1 END"),
}


def _act(functions: dict, name: str):
    def run(spark, sf_dir):
        x = ((F.col("event_id") * 37) % 200 - 100) / F.lit(10.0)
        rows = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
        return rows.select("event_id", F.round(functions[name](F.col("x")).cast("double"), 6).alias("y"))

    return run


for _name, (_f, _g) in _ACT.items():
    _from = f"FROM (SELECT event_id, {_X} AS x FROM events)"
    query(f"act_{_name}", f"SELECT event_id, round(({_f.format(x='x')})::DOUBLE, 6) AS y {_from}")(_act(activations.FORWARD, _name))
    query(f"act_grad_{_name}", f"SELECT event_id, round(({_g.format(x='x')})::DOUBLE, 6) AS y {_from}")(_act(activations.GRADIENT, _name))


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _rounded(values: Column) -> Column:
    return F.transform(values, lambda v: F.round(v, 6))


_E = "SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings"
_WEIGHTS = [[float(((i * 7 + j * 3) % 11) - 5) / 10 for j in range(5)] for i in range(64)]
_BIASES = [float(j) / 10 for j in range(5)]
_DENSE = "[" + ", ".join(f"list_dot_product(x, [{', '.join(str(_WEIGHTS[i][j]) for i in range(64))}]::DOUBLE[]) + {_BIASES[j]}" for j in range(5)) + "]"
_FLAT = "SELECT vec_id, unnest(range(len(y)::BIGINT))::INT AS pos, round(unnest(y), 6) AS y FROM"


def _cells(rows: DataFrame, y: Column, key: str = "vec_id") -> DataFrame:
    return rows.select(key, F.posexplode(_rounded(y)).alias("pos", "y"))


@query("nlayer_forward", f"{_FLAT} (SELECT vec_id, {_DENSE} AS y FROM ({_E}))")
def nlayer_forward(spark, sf_dir):
    return _cells(_vectors(spark, sf_dir), layers.dense(F.col("x"), _WEIGHTS, _BIASES))


@query(
    "nlayer_grad",
    f"""WITH e AS (SELECT vec_id, x, {_DENSE} AS y FROM ({_E})), a AS (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS xi FROM e),
        b AS (SELECT vec_id, unnest(range(5)) AS j, unnest(y) AS yj FROM e)
        SELECT i::INT AS i, j::INT AS j, round(sum(xi * yj), 4) AS dw FROM a JOIN b USING (vec_id) GROUP BY i, j""",
)
def nlayer_grad(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("dv", layers.dense(F.col("x"), _WEIGHTS, _BIASES))
    return layers.weight_gradient(rows, "x", "dv").withColumn("dw", F.round("dw", 4))


@query("nlayer_bias_grad", f"SELECT pos AS j, round(sum(y0), 4) AS db FROM (SELECT unnest(range(5))::INT AS pos, unnest({_DENSE}) AS y0 FROM ({_E})) GROUP BY pos")
def nlayer_bias_grad(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(layers.dense(F.col("x"), _WEIGHTS, _BIASES).alias("dv"))
    return layers.bias_gradient(rows, "dv").withColumn("db", F.round("db", 4))


_BACK = "[" + ", ".join(f"list_dot_product(d, [{', '.join(map(str, _WEIGHTS[i]))}]::DOUBLE[])" for i in range(64)) + "]"


@query("nlayer_input_grad", f"{_FLAT} (SELECT vec_id, {_BACK} AS y FROM (SELECT vec_id, {_DENSE} AS d FROM ({_E})))")
def nlayer_input_grad(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("d", layers.dense(F.col("x"), _WEIGHTS, _BIASES))
    return _cells(rows, layers.input_gradient(F.col("d"), _WEIGHTS))


_SOFT = "list_transform({v}, lambda a: exp(a - list_max({v})) / list_sum(list_transform({v}, lambda b: exp(b - list_max({v})))))"


@query("act_softmax", f"{_FLAT} (SELECT vec_id, {_SOFT.format(v='x')} AS y FROM ({_E}))")
def act_softmax(spark, sf_dir):
    return _cells(_vectors(spark, sf_dir), activations.softmax(F.col("x")))


@query(
    "act_grad_softmax",
    f"""{_FLAT} (SELECT vec_id, list_transform(list_zip(s, x), lambda p: p[1] * (p[2] - list_dot_product(s, x))) AS y FROM (SELECT vec_id, x, {_SOFT.format(v='x')} AS s FROM ({_E})))""",
)
def act_grad_softmax(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("s", activations.softmax(F.col("x")))
    return _cells(rows, activations.softmax_gradient(F.col("s"), F.col("x")))


@query("softmax_layer", f"{_FLAT} (SELECT vec_id, {_SOFT.format(v='z')} AS y FROM (SELECT vec_id, {_DENSE} AS z FROM ({_E})))")
def softmax_layer(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("z", layers.dense(F.col("x"), _WEIGHTS, _BIASES))
    return _cells(rows, activations.softmax(F.col("z")))


def _good(spark, sf_dir) -> DataFrame:
    return metrics.valid_predictions(table(spark, sf_dir, "predictions"), 10)


_OK = """good AS (SELECT id, scores, truth FROM predictions WHERE scores IS NOT NULL AND truth BETWEEN 0 AND 9 AND len(scores) = 10
    AND NOT list_contains(list_transform(scores, lambda s: s IS NULL OR isnan(s)), true)),
n AS (SELECT count(*) AS n FROM good),
z AS (SELECT id, truth, scores, list_transform(range(10), lambda k: CASE WHEN k = truth THEN 1.0::DOUBLE ELSE 0.0 END) AS y FROM good)"""
_CLIP = "least(greatest({p}, 1e-7), 1 - 1e-7)"
_ZIP = "list_zip(scores, y)"


@query("loss_cce", f"WITH {_OK} SELECT round(avg(-ln({_CLIP.format(p='scores[truth + 1]')})), 6) AS loss FROM good")
def loss_cce(spark, sf_dir):
    return _good(spark, sf_dir).agg(F.round(losses.categorical_cross_entropy(F.col("scores"), F.col("truth")), 6).alias("loss"))


def _loss(name: str, function, sql: str) -> None:
    def run(spark, sf_dir):
        rows = _good(spark, sf_dir).withColumn("y", losses.one_hot(F.col("truth"), 10))
        return rows.agg(F.round(function(F.col("scores"), F.col("y")), 6).alias("loss"))

    query(f"loss_{name}", f"WITH {_OK} SELECT round(avg(list_avg(list_transform({_ZIP}, lambda p: {sql}))), 6) AS loss FROM z")(run)


def _loss_grad(name: str, function, sql: str) -> None:
    def run(spark, sf_dir):
        rows = _good(spark, sf_dir).withColumn("y", losses.one_hot(F.col("truth"), 10))
        n = F.lit(_good(spark, sf_dir).count())
        return _cells(rows.withColumn("g", F.transform(function(F.col("scores"), F.col("y"), n), lambda v: v * n)), F.col("g"), "id")

    sql = f"""WITH {_OK}, g AS (SELECT id, list_transform({_ZIP}, lambda p: {sql}) AS y FROM z)
        SELECT id, unnest(range(10))::INT AS pos, round(unnest(y), 6) AS y FROM g"""
    query(f"loss_grad_{name}", sql)(run)


_CP = _CLIP.format(p="p[1]")
_loss("mse", losses.mean_squared_error, "(p[1] - p[2]) * (p[1] - p[2])")
_loss("bce", losses.binary_cross_entropy, f"-(p[2] * ln({_CP}) + (1 - p[2]) * ln(1 - {_CP}))")
_loss("mae", losses.mean_absolute_error, "abs(p[1] - p[2])")
_loss_grad("mse", losses.mean_squared_error_gradient, "-2 * (p[2] - p[1]) / 10")
_loss_grad("bce", losses.binary_cross_entropy_gradient, f"-(p[2] / {_CP} - (1 - p[2]) / (1 - {_CP})) / 10")
_loss_grad("mae", losses.mean_absolute_error_gradient, "sign(p[1] - p[2]) / 10")
_loss_grad("cce", lambda p, y, n: losses.categorical_cross_entropy_gradient(p, (F.array_position(y, 1.0) - 1).cast("int"), n), f"CASE WHEN p[2] = 1 THEN -1 / {_CP} ELSE 0 END")


def _updates(name: str, optimizer, sql: str) -> None:
    """One step of an optimizer on the bias gradient of a dense layer, from 0.5 each."""

    def run(spark, sf_dir):
        import numpy as np

        grads = {r["j"]: r["db"] for r in nlayer_bias_grad(spark, sf_dir).collect()}
        g = np.array([grads[j] for j in range(5)])
        new = optimizer().step({"b": np.full(5, 0.5)}, {"b": g})["b"]
        return spark.createDataFrame([(j, round(float(v), 6)) for j, v in enumerate(new)], "j int, b double")

    query(f"{name}_step", f"WITH g AS ({SQL['nlayer_bias_grad']}) SELECT j, round({sql}, 6) AS b FROM g")(run)


_updates("sgd", lambda: optimizers.SGD(0.01), "0.5 - 0.01 * db")
_updates("sgd_momentum", lambda: optimizers.SGD(0.01, momentum=0.9), "0.5 - 0.01 * db")
_updates("adagrad", lambda: optimizers.AdaGrad(0.01), "0.5 - 0.01 * db / (sqrt(db * db) + 1e-7)")
_updates("rmsprop", lambda: optimizers.RMSProp(0.01), "0.5 - 0.01 * db / (sqrt(0.1 * db * db) + 1e-7)")
_updates("adam", lambda: optimizers.Adam(0.01), "0.5 - 0.01 * db / (sqrt(db * db) + 1e-7)")
_updates("adamw", lambda: optimizers.AdamW(0.01), "0.5 - 0.01 * db / (sqrt(db * db) + 1e-7) - 0.01 * 0.01 * 0.5")


@query(
    "muon_scale",
    """SELECT m.mode, s.a AS n_inputs, s.b AS n_outputs, round(CASE m.mode WHEN 'naive' THEN 1 WHEN 'kellerjordan' THEN sqrt(greatest(1, b / a::DOUBLE))
       WHEN 'mup' THEN sqrt(b / a::DOUBLE) ELSE 0.2 * sqrt(greatest(a, b)) END, 6) AS scale
       FROM (VALUES ('naive'), ('kellerjordan'), ('mup'), ('moonlight')) m(mode), (VALUES (64, 5), (5, 64), (8, 8)) s(a, b)""",
)
def muon_scale(spark, sf_dir):
    rows = [(m, a, b, round(optimizers.scale(m, a, b), 6)) for m in ("naive", "kellerjordan", "mup", "moonlight") for a, b in ((64, 5), (5, 64), (8, 8))]
    return spark.createDataFrame(rows, "mode string, n_inputs int, n_outputs int, scale double")


@query("muon_step")
def muon_step(spark, sf_dir):
    import numpy as np

    cells = nlayer_grad(spark, sf_dir).collect()
    g = np.zeros((64, 5))
    for r in cells:
        g[r["i"], r["j"]] = r["dw"]
    new = optimizers.Muon().step({"w": np.zeros((64, 5))}, {"w": g})["w"]
    return spark.createDataFrame([(i, j, float(new[i, j])) for i in range(64) for j in range(5)], "i int, j int, w double")


@query("init_static", "SELECT (k // 5)::INT AS i, (k % 5)::INT AS j, 0.25::DOUBLE AS value FROM range(320) t(k)")
def init_static(spark, sf_dir):
    return initializers.Static(0.25).frame(spark, 64, 5)


@query(
    "init_bounds",
    """SELECT * FROM (VALUES ('xavier', 320::BIGINT, true), ('he', 320, true), ('lecun', 320, true), ('random', 320, true)) v(rule, n, inside)""",
)
def init_bounds(spark, sf_dir):
    rules = {"xavier": initializers.XavierGlorot, "he": initializers.HeKaiming, "lecun": initializers.LeCun, "random": initializers.Random}
    out = None
    for name, rule in rules.items():
        r = rule(mode="uniform", seed=5)
        row = r.frame(spark, 64, 5).agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"), (F.max(F.abs("value")) <= r.spread(64, 5)).alias("inside"))
        out = row if out is None else out.unionByName(row)
    return out


def _network():
    from threadloom.nn.model import CategoricalCrossEntropy, Model, NLayer, ReLU, Softmax

    return Model([NLayer(64, 16, initializers.HeKaiming(seed=1)), ReLU(), NLayer(16, 10, initializers.XavierGlorot(seed=2)), Softmax()], CategoricalCrossEntropy())


def _layer_sql(x: str, weights, biases) -> str:
    columns = (f"list_dot_product({x}, [{', '.join(map(repr, map(float, w)))}]::DOUBLE[]) + {float(b)!r}" for w, b in zip(weights.T, biases[0], strict=True))
    return "[" + ", ".join(columns) + "]"


def _inference_sql() -> str:
    first, _, second, _ = _network().elements
    hidden = f"list_transform({_layer_sql('x', first.weights, first.biases)}, lambda v: greatest(v, 0))"
    return f"""{_FLAT} (SELECT vec_id, {_SOFT.format(v='z')} AS y FROM (SELECT vec_id, {_layer_sql('h', second.weights, second.biases)} AS z FROM (SELECT vec_id, {hidden} AS h FROM ({_E}))))"""


@query("model_inference", _inference_sql())
def model_inference(spark, sf_dir):
    rows = _network().inference(_vectors(spark, sf_dir).withColumnRenamed("x", "features"))
    return _cells(rows, F.col("output"))


@query("model_train")
def model_train(spark, sf_dir):
    model = _network()
    rows = dataset.batches(_vectors(spark, sf_dir), "vec_id", 250).select("batch", F.col("x").alias("features"), F.array("label").alias("label"))
    history = model.train(rows, optimizers.Adam(0.01), epochs=2)
    return spark.createDataFrame(list(enumerate(map(float, history))), "epoch int, loss double")


# ---------------------------------------------------------- data set, tracker

@query("dataset_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= ceil(count(*) OVER () * 0.3) THEN 'head' ELSE 'tail' END AS part FROM orders")
def dataset_split(spark, sf_dir):
    return dataset.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query("dataset_batches", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch FROM orders")
def dataset_batches(spark, sf_dir):
    return dataset.batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 64)


@query("dataset_shuffle", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, (count(*) * (count(*) + 1) // 2)::BIGINT AS places FROM orders")
def dataset_shuffle(spark, sf_dir):
    mixed = dataset.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=2, epoch=1)
    return mixed.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.sum("place").alias("places"))


@query("dataset_length", "SELECT count(*) AS n FROM orders")
def dataset_length(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))


@query("tracker_every", "SELECT run_id, step, metric, class_id, CASE WHEN NOT isnan(value) THEN value END AS value FROM metric_history WHERE step % 100 = 0")
def tracker_every(spark, sf_dir):
    return tracker.sampled(table(spark, sf_dir, "metric_history"), 100).select("run_id", "step", "metric", "class_id", "value")


@query(
    "tracker_last",
    """WITH h AS (SELECT run_id, metric, class_id, step, CASE WHEN NOT isnan(value) THEN value END AS value FROM metric_history)
       SELECT run_id, metric, class_id, step, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, metric, class_id ORDER BY step DESC, value DESC NULLS LAST) AS rn FROM h) WHERE rn = 1""",
)
def tracker_last(spark, sf_dir):
    return tracker.last_values(table(spark, sf_dir, "metric_history"), "run_id", "metric", "class_id")


# -------------------------------------------------------------------- metrics

_CONF = f"""{_OK}, p AS (SELECT truth, list_position(scores, list_max(scores)) - 1 AS pred FROM good),
cells AS (SELECT truth, pred::INT AS pred, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT k::INT AS class_id, coalesce((SELECT sum(n) FROM cells WHERE truth = k AND pred = k), 0)::BIGINT AS tp,
      coalesce((SELECT sum(n) FROM cells WHERE truth = k), 0)::BIGINT AS row, coalesce((SELECT sum(n) FROM cells WHERE pred = k), 0)::BIGINT AS col FROM range(10) t(k)),
counts AS (SELECT class_id, tp, col - tp AS fp, row - tp AS fn, (SELECT n FROM n) - row - col + tp AS tn FROM c)"""


def _sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END)"


def _sql_inf(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 'inf'::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


_BASE = f"""m AS (SELECT *, {_sql_ratio('tp', 'tp + fp')} AS precision, {_sql_ratio('tp', 'tp + fn')} AS recall, {_sql_ratio('tn', 'tn + fp')} AS specificity,
    {_sql_ratio('tn', 'tn + fn')} AS npv, {_sql_ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
    {_sql_ratio('(tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)', '(tp + fp + fn + tn) * (tp + fp + fn + tn)')} AS expected,
    {_sql_ratio('tp * tn - fp * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc,
    {_sql_ratio('fp + fn', 'tp + fp + fn + tn')} AS hamming FROM counts),
full_ AS (SELECT *, {_sql_ratio('2 * precision * recall', 'precision + recall')} AS f1, {_sql_ratio('accuracy - expected', '1 - expected')} AS kappa,
    {_sql_inf('recall', '1 - specificity')} AS lr_plus, {_sql_inf('1 - recall', 'specificity')} AS lr_minus FROM m)"""
_NAMES = ["accuracy", "precision", "recall", "f1", "specificity", "npv", "mcc", "kappa", "lr_plus", "lr_minus", "hamming"]
_ROUNDED = ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES)


def _counts(spark, sf_dir) -> DataFrame:
    return metrics.class_counts(metrics.confusion(_good(spark, sf_dir)), 10)


@query("confusion_matrix", f"WITH {_CONF} SELECT truth, pred, n FROM cells")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_good(spark, sf_dir))


@query("metrics_per_class", f"WITH {_CONF}, {_BASE} SELECT class_id, tp, fp, fn, tn, {_ROUNDED} FROM full_")
def metrics_per_class(spark, sf_dir):
    return metrics.per_class(_counts(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in _NAMES})


@query("metrics_macro", f"WITH {_CONF}, {_BASE} SELECT {', '.join(f'round(avg({n}), 6) AS {n}' for n in ['precision', 'recall', 'f1', 'specificity', 'npv'])} FROM full_")
def metrics_macro(spark, sf_dir):
    names = ["precision", "recall", "f1", "specificity", "npv"]
    return metrics.macro(metrics.per_class(_counts(spark, sf_dir)), *names).withColumns({n: F.round(n, 6) for n in names})


@query("metrics_lr", f"WITH {_CONF}, {_BASE} SELECT class_id, round(lr_plus, 6) AS lr_plus, round(lr_minus, 6) AS lr_minus FROM full_")
def metrics_lr(spark, sf_dir):
    return metrics.per_class(_counts(spark, sf_dir)).select("class_id", F.round("lr_plus", 6).alias("lr_plus"), F.round("lr_minus", 6).alias("lr_minus"))


@query(
    "metrics_overall",
    f"""WITH {_CONF}, s AS (SELECT sum(tp)::DOUBLE AS c, sum(row)::DOUBLE AS s, sum(row * col)::DOUBLE AS pt, sum(col * col)::DOUBLE AS pp, sum(row * row)::DOUBLE AS tt FROM c)
        SELECT round(c / s, 6) AS accuracy, round({_sql_ratio('c * s - pt', 'sqrt((s * s - pp) * (s * s - tt))')}, 6) AS mcc,
               round({_sql_ratio('c / s - pt / (s * s)', '1 - pt / (s * s)')}, 6) AS k FROM s""",
)
def metrics_overall(spark, sf_dir):
    return metrics.overall(_counts(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in ("accuracy", "mcc", "k")})


@query(
    "metrics_topk",
    f"""WITH {_OK} SELECT round(avg(CASE WHEN len(list_filter(scores, lambda s: s > scores[truth + 1])) + len(list_filter(scores[:truth], lambda s: s = scores[truth + 1])) < 3
        THEN 1.0 ELSE 0.0 END), 6) AS top_k_accuracy FROM good""",
)
def metrics_topk(spark, sf_dir):
    return metrics.top_k_accuracy(_good(spark, sf_dir), 3, 10).withColumn("top_k_accuracy", F.round("top_k_accuracy", 6))


def _labelled(spark, sf_dir) -> DataFrame:
    """Several labels for each prediction: the true class, and the next one for even ids."""
    even = F.col("id") % 2 == 0
    own = lambda k: ((k == F.col("truth")) | (even & (k == (F.col("truth") + 1) % 10))).cast("int")
    return _good(spark, sf_dir).withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(9)), own))


_MULTI = f"""{_OK}, l AS (SELECT id, scores, list_transform(range(10), lambda k: CASE WHEN k = truth OR (id % 2 = 0 AND k = (truth + 1) % 10) THEN 1 ELSE 0 END) AS labels FROM good),
x AS (SELECT unnest(range(10))::INT AS label, unnest(scores) >= 0.2 AS p, unnest(labels) = 1 AS t FROM l),
counts AS (SELECT label, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM x GROUP BY label)"""


@query("metrics_multilabel", f"WITH {_MULTI}, {_BASE} SELECT label, tp, fp, fn, tn, {_ROUNDED} FROM full_")
def metrics_multilabel(spark, sf_dir):
    counts = metrics.label_counts(_labelled(spark, sf_dir), truth="labels", threshold=0.2)
    return metrics.per_class(counts).withColumns({n: F.round(n, 6) for n in _NAMES})


@query(
    "metrics_hamming_exact",
    f"""WITH {_MULTI}, e AS (SELECT avg(CASE WHEN list_transform(scores, lambda s: CASE WHEN s >= 0.2 THEN 1 ELSE 0 END) = labels THEN 1.0 ELSE 0.0 END) AS exact_match FROM l)
        SELECT round((SELECT sum(fp + fn)::DOUBLE / sum(tp + fp + fn + tn) FROM counts), 6) AS hamming, round(exact_match, 6) AS exact_match FROM e""",
)
def metrics_hamming_exact(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    counts = metrics.label_counts(rows, truth="labels", threshold=0.2)
    hamming = counts.agg(F.round(F.sum(F.col("fp") + F.col("fn")) / F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("hamming"))
    exact = metrics.exact_match(rows, truth="labels", threshold=0.2)
    both = hamming.withColumn("one", F.lit(1)).join(exact.withColumn("one", F.lit(1)), "one")
    return both.select("hamming", F.round("exact_match", 6).alias("exact_match"))


# ------------------------------------------------------------------- flagship

@query(
    "top_tokens",
    f"""WITH t AS ({_places(_gpt2_sql(f"lower({_CLEAN})"))}) SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 20""",
)
def top_tokens(spark, sf_dir):
    """The 20 most frequent pre-tokens of the normalised documents."""
    clean = text.lower(text.collapse_blanks(F.col("text")))
    tokens = _docs(spark, sf_dir).select(F.explode(text.split_keep(clean, text.GPT2)).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(20)
