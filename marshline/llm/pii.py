"""Personal data by fixed patterns and by bootstrapped lexical contexts, in DataFrame operations only.

Base spans come from four regular expressions. They are the seed entities of the bootstrap: the two words before a seed
are a lexical pattern, and a token that follows a pattern is an instance if it meets the token rule (a parameter, ``IDENTIFIER``: four
characters and two digits or more). Words are taken from the text whatever their length and distance. Patterns and
instances form a graph that is scored in rounds: a pattern's confidence is the score of its instances over all
occurrences of its two words in the corpus, whatever follows; an instance's score is one for seeds, else the
noisy-or of its patterns. Instances of confident patterns with enough different seeds are added as spans of kind ``id``.

Offsets are found by cutting the text at all matches and summing lengths, block by block, so a text with very many
matches costs no quadratic work. Expressions are written with lookbehind, ``\\G`` and possessive repeats where that
changes no match, so that long runs cost linear time and no stack.

Defined results: a null text is an empty one and has no spans. Rows with the same id and text share their added spans. A null id is
a value like any other. Only the named columns are read; ``redact`` keeps all others as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from marshline.llm.arrow import screen
from marshline.session import stage

_E = "A-Za-z0-9._%+-"
#: The kinds in their order, as expressions of the JVM.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_E}]))[{_E}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = "id"
_TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
_CONTEXT = r"(?:^|\s)(\S+)\s+(\S+)\s*$"
_COMPLETE = r"\s\S+\s+\S+\s*$"
_REVERSED = r"^\s*+(\S++)\s++(\S++)"
#: What a token must look like, once punctuation at its ends is off, to count as an instance of a pattern: four characters and two digits.
IDENTIFIER = r"^(?=.{4})[^0-9]*[0-9][^0-9]*[0-9]"
_REACH, _BLOCK = 70, 128
_SPAN = "array<struct<s:int,e:int,v:string,before:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, pattern: str) -> Column:
    """All matches from left to right: start, end (exclusive, code points), value and up to 70 characters of the text before, earlier matches included."""
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def size(z: Column) -> Column:
        return F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, z: n + size(z))

    def tail(*parts: Column) -> Column:
        return F.right(F.concat(*parts), F.lit(_REACH))

    def add(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["g"])
        one = F.struct(s.alias("s"), (s + F.length(z["m"])).alias("e"), z["m"].alias("v"), tail(acc["tail"], z["g"]).alias("before"))
        return F.struct((acc["at"] + size(z)).alias("at"), tail(acc["tail"], z["g"], F.coalesce(z["m"], F.lit(""))).alias("tail"),
                        F.when(z["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    def spans(pair: Column) -> Column:
        start = F.struct(pair["at"]["at"].alias("at"), pair["at"]["tail"].alias("tail"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(pair["b"], start, add, lambda acc: acc["out"])

    def all_blocks(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _BLOCK).cast("int")), lambda i: F.slice(z, i * _BLOCK + 1, F.lit(_BLOCK)))

    def ending(block: Column, before: Column) -> Column:
        return F.aggregate(block, before, lambda t, z: tail(t, z["g"], F.coalesce(z["m"], F.lit(""))))

    def starts(blocks: Column) -> Column:
        """Of each block, its offset and the characters before it."""
        begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<at:int,tail:string>>").alias("out"))
        return F.aggregate(blocks, begin, lambda acc, b: F.struct(
            (acc["at"] + total(b)).alias("at"), ending(b, acc["tail"]).alias("tail"),
            F.array_append(acc["out"], F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"))).alias("out")), lambda acc: acc["out"])

    located = let(let(cut, all_blocks), lambda blocks: F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), starts(blocks).alias("at")), spans)))
    return F.when(text.rlike(pattern), located).otherwise(F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _luhn(digits: Column) -> Column:
    def add(n: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        return n + F.when(i % 2 == 0, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _small),
    "card": lambda v: let(_digits(v), lambda d: F.length(d).between(12, 19) & _luhn(d)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}


def _context(text: Column, start: Column, before: Column) -> Column:
    """The two words before a match, in lower case; empty where there are fewer. ``before``: up to ``_REACH`` characters before it."""
    near = F.lower(before)
    short = F.struct(F.regexp_extract(near, _CONTEXT, 1).alias("w1"), F.regexp_extract(near, _CONTEXT, 2).alias("w2"))
    # Where long words or wide gaps leave less than two whole words within reach, the text before is read from its end.
    far = let(F.reverse(F.lower(F.substr(text, F.lit(1), start))), lambda r: F.struct(
        F.reverse(F.regexp_extract(r, _REVERSED, 2)).alias("w1"), F.reverse(F.regexp_extract(r, _REVERSED, 1)).alias("w2")))
    return F.when((start <= _REACH) | near.rlike(_COMPLETE), short).otherwise(far)


def scan(df: DataFrame, key: str, text: str, identifier: str = IDENTIFIER) -> DataFrame:
    """_id, _h (hash of the text), the base spans and the tokens with digits, each with the two words before it."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    none = F.array().cast(_SPAN)

    def kept(k: str) -> Column:
        return F.filter(F.when(F.col("_text").rlike(_NEEDS[k]), found(F.col("_text"), PATTERNS[k])).otherwise(none), lambda x: VALID[k](x["v"])).alias(k)

    out = rows.select("_id", "_h", "_text", *map(kept, PATTERNS),
        F.when(F.col("_text").rlike("[0-9]"), found(F.col("_text"), _TOKEN)).otherwise(none).alias("_tokens"))

    def trimmed(x: Column) -> Column:
        lead = F.length(x["v"]) - F.length(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}]+", ""))
        v = F.regexp_replace(F.regexp_replace(x["v"], r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")
        return let(v, lambda w: F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(w)).alias("e"), w.alias("v"), _context(F.col("_text"), x["s"], x["before"]).alias("c")))

    def base(k: str, i: int) -> Column:
        return F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("o"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v"),
                                                 _context(F.col("_text"), x["s"], x["before"]).alias("c")))

    spans = F.array_sort(F.concat(*[base(k, i) for i, k in enumerate(PATTERNS)]))
    tokens = F.filter(F.transform("_tokens", trimmed), lambda x: x["v"].rlike(identifier) & (x["c"]["w2"] != ""))
    return out.select("_id", "_h", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], spans.alias("_spans"), tokens.alias("_tokens"))


def confident_contexts(scanned: DataFrame, texts: DataFrame, text: str, min_seeds: int, confidence: float, rounds: int) -> DataFrame | None:
    """(w1, w2) of the patterns that the bootstrap trusts; None where no pattern has enough seeds."""
    seeds = scanned.select(F.explode("_spans").alias("x")).where("x.c.w2 <> ''").groupBy("x.c.w1", "x.c.w2", "x.v").agg(F.count("*").alias("n_seed"))
    known = seeds.groupBy("w1", "w2").agg(F.countDistinct("v").alias("seeds")).where(F.col("seeds") >= min_seeds)
    patterns = stage(known, "patterns")
    if patterns.isEmpty():
        return None
    others = scanned.select(F.explode("_tokens").alias("x")).groupBy("x.c.w1", "x.c.w2", "x.v").agg(F.count("*").alias("n_other"))
    pairs = F.flatten(F.transform(F.array(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")), lambda ws: F.arrays_zip(
        F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))).alias("w1"), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))).alias("w2"))))
    # Word pairs are screened and counted before they are joined, so no occurrence becomes a joined row.
    seen = texts.select(F.inline(pairs)).where(screen(patterns, "w1", "w2")("w1", "w2")).groupBy("w1", "w2").agg(F.count("*").alias("seen"))
    sizes = stage(patterns.join(seen, ["w1", "w2"], "left"), "patterns")
    edges = stage(seeds.join(others, ["w1", "w2", "v"], "full").join(patterns.select("w1", "w2"), ["w1", "w2"]).select(
        "w1", "w2", "v", F.greatest(F.coalesce("n_seed", F.lit(0)), F.coalesce("n_other", F.lit(0))).alias("n"), F.col("n_seed").isNotNull().alias("seed")), "edges")
    score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    instances = None
    for _ in range(rounds):
        scored = edges.withColumn("score", F.lit(0.0)) if instances is None else edges.join(instances, "v", "left")
        own = scored.groupBy("w1", "w2").agg(F.sum(F.col("n") * score).alias("hit"), F.sum("n").alias("n"))
        trust = stage(own.join(sizes, ["w1", "w2"]).select("w1", "w2", (F.col("hit") / F.greatest("n", F.coalesce("seen", F.lit(0)))).alias("trust")), "trust")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))
        instances = edges.join(trust, ["w1", "w2"]).groupBy("v").agg((1 - doubt).alias("score"))
    return trust.where(F.col("trust") >= confidence).select("w1", "w2")


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text", min_seeds: int = 3, confidence: float = 0.5, rounds: int = 3,
                  identifier: str = IDENTIFIER) -> DataFrame:
    """_id, _h, counts by kind, _spans (base) and _added (of kind ``id``, clear of base spans) of every row."""
    scanned = stage(scan(df, key, text, identifier), "scanned")
    trusted = confident_contexts(scanned, df, text, min_seeds, confidence, rounds)
    kind = "array<struct<s:int,e:int>>"
    if trusted is None:
        return scanned.withColumn("_added", F.array().cast(kind))
    new = (scanned.select("_id", "_h", F.explode("_tokens").alias("x")).select("_id", "_h", "x.c.w1", "x.c.w2", "x.s", "x.e")
           .join(trusted, ["w1", "w2"]).groupBy("_id", "_h").agg(F.collect_set(F.struct("s", "e")).alias("_new")))
    both = scanned.alias("d").join(new.alias("n"), F.expr("d._id <=> n._id and d._h = n._h"), "left").select("d.*", "n._new")
    clear = F.filter("_new", lambda a: ~F.exists("_spans", lambda b: (a["s"] < b["e"]) & (b["s"] < a["e"])))
    return both.withColumn("_added", F.coalesce(clear, F.array().cast(kind))).drop("_new")


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _plain(i: int, k: str | None = None) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), (x["o"] if k is None else F.lit(i)).alias("o"), (x["k"] if k is None else F.lit(k)).alias("k"), x["e"].alias("e"))


def all_spans() -> Column:
    """Base and added spans by start, then kind."""
    return F.array_sort(F.concat(F.transform("_spans", _plain(0)), F.transform("_added", _plain(len(PATTERNS), ADDED))))


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts, a digest of the base spans and all spans as text."""
    rows = personal_data(df, key, text)
    return rows.select(F.col("_id").alias(key), *[f"n_{k}" for k in PATTERNS], F.sha2(_named(F.col("_spans")).cast("binary"), 256).alias("base_sha256"),
                       _named(all_spans()).alias("spans"))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with every span of ``text`` replaced by its kind in brackets. Spans that overlap are masked as one."""
    found_in = stage(personal_data(df, key, text).select("_id", "_h", all_spans().alias("_all")).where(F.size("_all") > 0).dropDuplicates(["_id", "_h"]), "spans")
    # Rows that cannot have spans stay where they are; only the others move to meet theirs.
    maybe = screen(found_in, "_id", "_h")(F.col(f"`{key}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    body = F.coalesce(F.col(f"d.`{text}`"), F.lit(""))
    joined = df.where(maybe).alias("d").join(found_in.alias("f"), F.col(f"d.`{key}`").eqNullSafe(F.col("f._id")) & (F.xxhash64(body) == F.col("f._h")), "left")

    def put(acc: Column, x: Column) -> Column:
        gap = F.substr(acc["t"], acc["at"] + 1, x["s"] - acc["at"])
        fresh = x["s"] >= acc["at"]
        return F.struct(acc["t"].alias("t"), F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate(F.col("f._all"), F.struct(body.alias("t"), F.lit(0).alias("at"), F.lit("").alias("out")), put,
                         lambda acc: F.concat(acc["out"], F.substr(acc["t"], acc["at"] + 1)))
    new = F.when(F.col("f._all").isNull(), F.col(f"d.`{text}`")).otherwise(masked)
    return joined.select(*[new.alias(c) if c == text else F.col(f"d.`{c}`") for c in df.columns]).unionByName(df.where(~maybe))
