"""Secret scan: key-like runs of characters, sorted out by a random forest.

Every run of key characters of some length is a candidate; a shorter run, or a quoted value with other signs,
is one if a keyword or an assignment stands before it and it holds a letter beside a digit or sign. The forest removes false positives by length,
character classes and their changes, coverage by frequent letter triples of the corpus' long words, signs
of a path, and the words beside it. It is trained from labelled findings: rows of `candidates` with a
`label`, either given or set by `rule_labels`. Only DataFrame functions and the built-in forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.stage import cut, marked, marks, unused

KEY = "[A-Za-z0-9+/_-]"  # an equals sign ends a name or fills up a value
SIGN = "[^A-Za-z0-9+/_=.-]"
KEYWORD = r"(?i)(token|secret|passw|pwd|api.?key|apikey|access.?key|credential|auth(?!or)|private|bearer|signature)"
ASSIGNED = r"[=:]\s*[\"'`]?$"
NEAR = 40  # characters before a run that count as its neighbours
FEATURES = [
    "length", "digits", "uppers", "distinct", "changes", "vowels", "covered", "slashes", "signs", "dots", "named", "assigned", "quoted", "next_is_word",
]
MARK = "<secret>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 16, short: int = 6, most: int = 64) -> DataFrame:
    """(id, text_hash, place, word, run, head, before, before2, after): runs of at least `least` key characters,
    and behind a keyword or an assignment runs of at least `short` and quoted values of at most `most` characters.

    `place` numbers the word a run stands in, `head` is what the word holds before it (NEAR characters), `before2`,
    `before` and `after` are its neighbours; of words longer than `most` + 4 * NEAR `word` holds the head and the run.
    A name and an equals sign before a value are no part of a run."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), F.split(text, r"[\x20\x09-\x0D]+").alias("w"))
    near = lambda i, by: F.coalesce(F.get("w", i + by), F.lit(""))
    tied = lambda i: F.get("w", i).rlike("[=:]") | near(i, -1).rlike("[=:]$") | F.concat_ws(" ", near(i, -2), near(i, -1)).rlike(KEYWORD)
    # most words are too short or stand alone: only numbers of the others go on
    lengthy = lambda i: (F.length(F.get("w", i)) >= least) & F.get("w", i).rlike(f"{KEY}{{{least},}}")
    brief = lambda i: (F.length(F.get("w", i)) >= short) & F.get("w", i).rlike(f"[0-9]|{SIGN}") & F.get("w", i).rlike("[A-Za-z]") & tied(i)
    some = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: lengthy(i) | brief(i))
    side = lambda c: F.substring(c, -NEAR, NEAR)
    found = F.transform(some, lambda i: F.struct(i.alias("place"), F.get("w", i).alias("word"), side(near(i, -1)).alias("before"), side(near(i, -2)).alias("before2"), F.left(near(i, 1), F.lit(NEAR)).alias("after")))
    rows = words.select("id", "text_hash", F.explode(found).alias("s")).select("id", "text_hash", "s.*")

    start, end = f"(?<!{KEY})", f"(?!{KEY})"
    patterns = [
        f"{start}({KEY}{{{least},}}+=*+){end}",
        f"{start}({KEY}{{{short},{least - 1}}}+=*+){end}",
        rf"[\"'`]([^\"'`\\]{{{short},{most}}}+)[\"'`]",
    ]

    def pieces(kind: int) -> Column:
        """What stands before each run of one pattern, as far as no earlier run does, and the run."""
        at = F.lit(rf"(.{{0,{NEAR}}}?){patterns[kind]}")
        return F.arrays_zip(F.regexp_extract_all("word", at, F.lit(1)).alias("head"), F.regexp_extract_all("word", at, F.lit(2)).alias("run"))

    def whole(kind: int) -> Column:
        """The pieces with heads of NEAR characters, through earlier runs too, and the rules for brief runs."""
        name, back = f"p{kind}", range(-(-NEAR // short), 0, -1)
        earlier = lambda i: [F.coalesce(F.get(name, i - k)[f], F.lit("")) for k in back for f in ("head", "run")]
        both = F.transform(name, lambda p, i: F.struct(side(F.concat(*earlier(i), p["head"])).alias("head"), p["run"].alias("run")))
        if kind == 0:
            return both
        ahead = lambda p: F.concat_ws(" ", "before2", "before", p["head"])
        mixed = lambda p: p["run"].rlike("[A-Za-z]") & p["run"].rlike(f"[0-9]|{SIGN}")
        plain = lambda p: ~p["run"].rlike(f"^{KEY}+=*$")
        tied = lambda p: ahead(p).rlike(KEYWORD) | F.concat_ws(" ", "before", p["head"]).rlike(ASSIGNED)
        return F.filter(both, lambda p: mixed(p) & tied(p) & (plain(p) if kind == 2 else F.lit(True)))

    rows = rows.select("*", *[pieces(k).alias(f"p{k}") for k in range(3)])
    rows = rows.select("*", F.explode(F.concat(*[whole(k) for k in range(3)])).alias("p")).select("*", "p.*").drop("p", "p0", "p1", "p2")
    cut_off = F.length("word") > most + 4 * NEAR
    return rows.withColumn("word", F.when(cut_off, F.concat("head", "run")).otherwise(F.col("word")))


def frequent_triples(found: DataFrame, share: int = 2000) -> list[int]:
    """A bitmap of the letter triples a-z that make up at least one in `share` of those in all runs."""
    low = F.lower("run")
    triples = F.transform(F.sequence(F.lit(1), F.length("run") - 2), lambda i: F.substring(low, i, F.lit(3)))
    each = found.select(F.explode(triples).alias("t")).filter(F.col("t").rlike("^[a-z]{3}$"))
    counts = each.groupBy("t").count().collect()  # 26 ** 3 rows at most
    total, bitmap = sum(r["count"] for r in counts), [0] * (26**3 // 64 + 1)
    for r in counts:
        if r["count"] * share >= total:
            a, b, c = (ord(x) - 97 for x in r["t"])
            n = (a * 26 + b) * 26 + c
            bitmap[n // 64] |= 1 << n % 64
    return [x - (1 << 64) if x >> 63 else x for x in bitmap]


def features(found: DataFrame, bitmap: list[int]) -> DataFrame:
    run, low = F.col("run"), F.lower("run")
    size = F.length("run")
    count = lambda kind: (size - F.length(F.regexp_replace(run, kind, ""))) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(run, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "0"), "[^lu0]", "s")
    marked = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<long>")

    def known(i: Column) -> Column:
        a, b, c = (F.ascii(F.substring(low, i + k, F.lit(1))) - 97 for k in range(3))
        n = (a * 26 + b) * 26 + c
        inside = a.between(0, 25) & b.between(0, 25) & c.between(0, 25)
        bit = F.call_function("shiftright", F.get(marked, F.floor(n / 64).cast("int")), (n % 64).cast("int")).bitwiseAND(F.lit(1))
        return inside & (bit == 1)

    covered = F.size(F.filter(F.sequence(F.lit(1), size - 2), known)) / (size - 2)
    context = F.concat_ws(" ", "before2", "before", "head")
    columns = {
        "length": size.cast("double"),
        "digits": count("[0-9]"),
        "uppers": count("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(run, ""))) / size,
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) / size,
        "vowels": count("[aeiouAEIOU]"),
        "covered": covered.cast("double"),
        "slashes": count("[/]"),
        "signs": count(SIGN),
        "dots": F.col("word").contains(".").cast("double"),
        "named": context.rlike(KEYWORD).cast("double"),
        "assigned": context.rlike(ASSIGNED).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "next_is_word": F.col("after").rlike(r"^\p{L}+[.,]?$").cast("double"),
    }
    return found.select("*", *[c.alias(n) for n, c in columns.items()])


def rule_labels(rows: DataFrame) -> DataFrame:
    """`label` 1 for runs of letters and digits or signs that are assigned to a keyword, 0 for runs without
    keyword that are letters or digits only, null where neither rule decides. The rules look at some of the
    features, so a forest trained from them repeats the rules on clear cases; reviewed findings, given as
    labels, are better."""
    part = F.col("digits") + F.col("signs")
    mixed = (part > 0.1) & (F.col("digits") < 0.95) & (F.col("distinct") > 0.2)
    sure = (F.col("named") == 1) & (F.col("assigned") == 1) & mixed
    plain = (F.col("named") == 0) & ((part == 0) | (F.col("digits") == 1))
    return rows.withColumn("label", F.when(sure, 1.0).when(plain, 0.0))


def train(labelled: DataFrame, sample: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest from the rows with a label, about `sample` of each class at most, chosen by a hash of the
    run; None if a class is missing."""
    rows = labelled.filter("label IS NOT NULL")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    part = F.pmod(F.xxhash64("run", "before", "after"), F.lit(1 << 30)) / (1 << 30)
    rows = rows.filter(F.coalesce(*[F.when(F.col("label") == v, part * n < sample) for v, n in sizes.items()]))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: DataFrame | None = None, least: float = 0.5, kept: list[str] | None = None) -> DataFrame:
    """`(id_col, text_hash, place, run, probability)` of each run that the forest takes for a secret.

    `given` are labelled findings (columns of `candidates` and `label`); without it `rule_labels` sets them.
    If a class is missing there is no forest and runs labelled 1 by the rules are the result. Null and empty
    texts have no runs, null ids stay null, repeated rows give their findings each, an empty table gives no
    rows, other columns are not read. Work is done where rows are read; only counts are shuffled.
    """
    kept = [] if kept is None else kept
    found = cut(candidates(docs, id_col, text_col), kept)
    bitmap = frequent_triples(found)
    rows = cut(rule_labels(features(found, bitmap)), kept)
    labels = rows if given is None else given if set(FEATURES) <= set(given.columns) else features(given, bitmap)
    model = train(labels)
    if model is None:
        judged = rows.withColumn("probability", F.coalesce("label", F.lit(0.0)))
    else:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        judged = model.transform(assembled).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return judged.filter(F.col("probability") >= least).select(F.col("id").alias(id_col), "text_hash", "place", "run", "probability")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: list[str] | None = None) -> DataFrame:
    """Rows of `docs` with each secret replaced by a mark; a column `n_chars` is brought in line where text changes.

    No row goes and no other column changes. Null and empty texts stay as they are, rows repeated as a whole
    change alike, null ids match by their text, an empty table stays empty.
    """
    kept = [] if kept is None else kept
    s_id, s_hash, runs, may = unused(docs, "__id", "__hash", "__runs", "__may")
    secrets = scan(docs, id_col, text_col, kept=kept).groupBy(F.col(id_col).alias(s_id), F.col("text_hash").alias(s_hash))
    secrets = secrets.agg(F.array_sort(F.collect_set("run"), lambda a, b: F.length(b) - F.length(a)).alias(runs))
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    secrets = cut(secrets, kept)
    bitmap = marks(secrets.select(F.xxhash64(s_id, s_hash).alias("key")))
    here = docs.withColumn(may, marked(bitmap, F.xxhash64(F.col(f"`{id_col}`"), key)))
    match = F.col(f"`{id_col}`").eqNullSafe(F.col(s_id)) & (key == F.col(s_hash))
    joined = here.filter(F.col(may)).join(secrets, match, "left")
    alone = lambda s: F.concat(F.lit(rf"(?<!{KEY})\Q"), s, F.lit(rf"\E(?!{KEY})"))  # noqa: E731  short ones may be parts of words
    clean = F.when(F.col(runs).isNull(), F.col(f"`{text_col}`")).otherwise(F.aggregate(runs, F.col(f"`{text_col}`"), lambda t, s: F.regexp_replace(t, alone(s), F.lit(MARK))))
    out = {text_col: clean}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(runs).isNull(), F.col("n_chars")).otherwise(F.length(clean)).cast(docs.schema["n_chars"].dataType)
    changed = joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
    return here.filter(~F.col(may)).drop(may).unionByName(changed)
