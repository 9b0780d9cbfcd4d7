"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is addressed by the SHA-256 of its content.  The ledger holds,
for each blob and rule version that was ever scanned, the spans that were found.  A run
scans each unseen pair of a blob and a rule version once, however many documents hold
that blob, appends to the ledger and joins the spans back to all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import materialise, new_path, unused_names, whole_text


@dataclass(frozen=True)
class Rule:
    """Finds leftmost matches that don't overlap; those whose group is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base, in the order in which spans that start together are listed.
BASE = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
RULES = (
    *BASE, Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}")
)

#: Elements of an array that are walked as one block.
SPAN_BLOCK = 256
#: Code points of a block in which a long text is cut before parts of it are taken.
TEXT_BLOCK = 4096
_SPANS = "array<struct<start:int,end:int>>"
_PLACE = "struct<start:int,end:int,kept:boolean>"
LEDGER = f"blob binary, kind string, version int, spans {_SPANS}"


def running(elements: Column, zero: Column, step, state, like: Column) -> Column:
    """For each element ``step(state before it, element)``, where ``state`` takes the state from the last result.

    The array is walked block by block: one that grows by an element at a time would be
    copied as often as it has elements.  ``like`` is a value of the result's type.
    """
    none = F.filter(F.array(like), lambda _: F.lit(False))

    def one(at: Column, element: Column) -> Column:
        new = step(at["state"], element)
        return F.struct(state(new).alias("state"), F.concat(at["out"], F.array(new)).alias("out"))

    def block(at: Column, k: Column) -> Column:
        here = F.slice(at["elements"], k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK))
        now = F.aggregate(here, F.struct(at["now"]["state"].alias("state"), none.alias("out")), one)
        return F.struct(
            at["elements"].alias("elements"),
            now.alias("now"),
            F.concat(at["done"], F.array(at["now"]["out"])).alias("done"),
        )

    start = F.struct(
        elements.alias("elements"),
        F.struct(zero.alias("state"), none.alias("out")).alias("now"),
        F.filter(F.array(none), lambda _: F.lit(False)).alias("done"),
    )
    blocks = F.sequence(F.lit(0), F.floor(F.size(elements) / SPAN_BLOCK).cast("int"))
    return F.aggregate(
        blocks, start, block, lambda at: F.flatten(F.concat(at["done"], F.array(at["now"]["out"])))
    )


def spans(text: Column, rule: Rule) -> Column:
    """Where the rule's matches start and end, in code points.

    The lengths of the matches and of what lies between them add up to the places.
    """
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def pair(match: Column, gap: Column) -> Column:
        kept = match.isNotNull()
        if rule.least:
            kept &= F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least
        return F.struct(
            F.length(gap).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("n"), kept.alias("kept")
        )

    def place(at: Column, p: Column) -> Column:
        start = at + p["gap"]
        return F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["kept"].alias("kept"))

    pairs = F.zip_with(found, between, pair)
    walked = running(pairs, F.lit(0), place, lambda one: one["end"], F.struct(F.lit(0), F.lit(0), F.lit(False)).cast(_PLACE))
    kept = F.transform(
        F.filter(walked, lambda one: one["kept"]), lambda one: F.struct(one["start"].alias("start"), one["end"].alias("end"))
    )
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array().cast(_SPANS))


def blob(text_column: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(text_column), 256))


def scan_unseen(texts: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of the unseen pairs of ``texts`` (blob, text) and rules; each blob is scanned once."""
    once = texts.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        once = once.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
        once = once.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        )
        once = once.filter(F.size("todo") > 0)
    scanned = [
        F.when(
            F.array_contains("todo", r.key),
            F.struct(
                F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")
            ),
        ) for r in rules
    ]
    return once.select("blob", F.explode(F.array_compact(F.array(*scanned))).alias("s")).select("blob", "s.*")


def update_ledger(texts: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Appends the unseen pairs to the ledger at ``path``, which is made if there is none, and returns it."""
    spark = texts.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    scan_unseen(
        texts, spark.read.schema(LEDGER).parquet(path) if there else None, rules
    ).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(
    docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES, text_column: str = "text"
) -> DataFrame:
    """All columns of ``docs`` and ``findings``: array of (start, place of the rule, kind, end), ordered.

    Null text counts as empty and has none.  Rows that repeat a text share one scan;
    every row gets its own result.  Without ``ledger_path`` the ledger is a new one.  Runs
    that append to a ledger at the same time may both scan a pair: what it holds twice counts
    once.
    """
    address, found = unused_names(docs, "blob", "findings")
    ledger = update_ledger(
        docs.select(blob(text_column).alias("blob"), whole_text(text_column).alias("text")),
        ledger_path or new_path(docs.sparkSession, "secrets-ledger"),
        rules,
    )
    place = F.create_map(
        *(x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k)))
    )[F.concat_ws("@", "kind", "version")]
    hits = ledger.filter(F.size("spans") > 0).withColumn("place", place).filter("place is not null")
    one = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"), F.col("place").alias("place"), F.col("kind").alias("kind"), s["end"].alias("end")
        ),
    )
    # Written, so that both sides of the join have an exchange of their own and a blob of very many documents can be split.
    hits = materialise(
        hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set(one))).alias(found)), "secrets-found"
    ).withColumnRenamed("blob", address)
    joined = docs.withColumn(address, blob(text_column)).join(hits, address, "left")
    return joined.select(
        *docs.columns, F.coalesce(F.col(found), F.array().cast(hits.schema[found].dataType)).alias(found)
    )


def written(found: Column) -> Column:
    """Findings as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def secret_report(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    held = findings(docs.select("doc_id", "text"), ledger_path, rules)
    base = F.filter("findings", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    counts = [F.size(F.filter("findings", of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return held.select(
        "doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("findings")).alias("spans")
    )


def redact(
    docs: DataFrame,
    ledger_path: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    mark: str = "[secret]",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; texts without any stay as they are, null ones too.

    Spans that overlap are replaced together, those that touch each on their own.  Rows need
    no ids; those that repeat one another are cleaned alike.
    """
    held = findings(docs, ledger_path, rules, text_column)
    name = held.columns[-1]
    cleaned = _without(F.col(text_column), F.col(name), mark)
    return held.withColumn(
        text_column, F.when(F.size(name) > 0, cleaned).otherwise(F.col(text_column))
    ).select(*docs.columns)


def _without(text: Column, found: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each stretch that ordered spans cover together.

    The text is cut into blocks once; what is kept between two stretches is taken from the
    blocks that it lies in, so a place far on in the text costs no more than one at its front.
    """
    whole = F.concat(found.cast("array<struct<start:int,place:int,kind:string,end:int>>"), F.array(
        F.struct(F.length(text).alias("start"), F.lit(0).alias("place"), F.lit("").alias("kind"), F.length(text).alias("end"))
    ))

    def gap(at: Column, s: Column) -> Column:
        """From where all spans before have ended to where this one begins."""
        return F.struct(at.alias("a"), s["start"].alias("b"), F.greatest(at, s["end"]).alias("end"))

    like = F.struct(F.lit(0), F.lit(0), F.lit(0)).cast("struct<a:int,b:int,end:int>")
    gaps = running(whole, F.lit(0), gap, lambda g: g["end"], like)
    # A gap of no length between two spans that touch stays, one before a span that begins inside another goes.
    gaps = F.filter(gaps, lambda g: g["b"] >= g["a"])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def part(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / TEXT_BLOCK).cast("int"), F.floor(b / TEXT_BLOCK).cast("int")
        block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
        from_, to = a - first * TEXT_BLOCK, b - last * TEXT_BLOCK
        return F.when(first == last, F.substring(block(first), from_ + 1, to - from_)).otherwise(
            F.concat(
                F.substring(block(first), from_ + 1, F.lit(TEXT_BLOCK)),
                F.array_join(F.slice(blocks, first + 2, last - first - 1), ""),
                F.substring(block(last), F.lit(1), to),
            )
        )

    # Bound as fields of one element, so that they are made once and not for each gap.
    bound = F.array(F.struct(blocks.alias("blocks"), gaps.alias("gaps")))
    joined = F.transform(
        bound, lambda x: F.array_join(F.transform(x["gaps"], lambda g: part(x["blocks"], g["a"], g["b"])), mark)
    )
    return F.get(joined, F.lit(0))
