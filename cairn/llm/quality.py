"""Quality rules as a ledger of failure bits and measurements; policies are bit masks over it.

Every rule is evaluated once for each text. The ledger has the measurements and one long whose bit r
tells that rule r failed. A policy names the bits that reject; policies are versioned, can be applied
to a written ledger at any later time, and ablations (what each rule alone rejects, what leaving it
out would keep) are bitwise aggregates of the ledger, never a second pass over texts.

Only built-in functions are used, without a shuffle: repeated windows are found inside each row, by
sorting (hash << 31 | position) longs and then comparing the words of equal hashes.

Edge cases: null or empty text has no words and fails few_words; extra columns of any name are ignored;
a null id and repeated rows are judged like any other; very long texts are measured whole, in their own
row; an empty table gives no rows, and ablations of nothing are zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Bit by position; never reorder, only append.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("duplicate_lines", "n_lines > 3 and 100 * n_dup_lines > 60 * n_lines"),
    ("symbols", "100 * n_symbols > 60 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
POLICIES: dict[str, int] = {
    "base": BITS["few_words"] | BITS["repeated_windows"],
    "v1": sum(BITS.values()),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(w: Column) -> Column:
    """Words in windows of three words that occur twice or more."""
    n = F.size(w)
    low = F.lit((1 << 31) - 1)
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).cast("long"), 31).bitwiseOR(i.cast("long"))))

    def alike(x, k, all_, key):
        return F.coalesce(key(x) == key(F.get(all_, k - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(all_, k + 1)), F.lit(False))

    at = _let(packed, lambda s: F.transform(F.filter(s, lambda x, k: alike(x, k, s, lambda v: F.shiftright(v, 31))), lambda x: x.bitwiseAND(low).cast("int")))
    texts = F.sort_array(F.transform(at, lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("g"), p.alias("p"))))
    spots = _let(texts, lambda e: F.sort_array(F.transform(F.filter(e, lambda x, k: alike(x, k, e, lambda v: v["g"])), lambda x: x["p"])))
    covered = _let(spots, lambda d: F.aggregate(F.transform(d, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b))
    return F.when(n >= 3, covered).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """A struct of all measurements of a text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, SPACE, -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")
    return _let(F.struct(of_words.alias("w"), of_lines.alias("x"), symbols.alias("s")), lambda m: F.struct(m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"), m["s"].alias("n_symbols"), m["x"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"), m["x"]["n_lines"].alias("n_lines")))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, rule_bits): one row for each row of df."""
    m = df.select(F.col(id_col).alias("doc_id"), F.inline(F.array(measures(F.col(text_col)))))
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("rule_bits", total)


def apply_policy(entries: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    failed = lambda name: F.col("rule_bits").bitwiseAND(F.lit(POLICIES[name])) != 0
    return entries.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(version))


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """(rule, failed, only_this, kept_without): documents that fail a rule, that only it rejects, and that stay if it goes."""
    mask = POLICIES[version]
    spark = entries.sparkSession
    counts = entries.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("b")).agg(F.count("*").alias("c"))
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).cast("long").alias("bit")) for name, _ in RULES if BITS[name] & mask])
    # a row for each rule and set of bits, however many documents there are
    each = spark.range(1).select(F.inline(named)).join(counts, F.lit(True), "left")
    has = F.col("b").bitwiseAND(F.col("bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0).cast("long"))
    return each.groupBy("rule").agg(total(has).alias("failed"), total(F.col("b") == F.col("bit")).alias("only_this"), total((F.col("b") == 0) | (F.col("b") == F.col("bit"))).alias("kept_without"))


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), windows as (
  select doc_id, i, count(*) over (partition by doc_id, g) as c
  from (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from w, unnest(range(1, len(ws) - 1)) as u(i))
), repeated as (
  select doc_id, count(distinct i + k) as n from windows, unnest([0, 1, 2]) as v(k) where c > 1 group by doc_id
), lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as x from w) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id
), m as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(repeated.n, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
  from w left join repeated using (doc_id) left join lines using (doc_id)
), b as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (n_lines > 3 and 100 * n_dup_lines > 60 * n_lines)::bigint
    + 8 * (100 * n_symbols > 60 * n_words)::bigint + 16 * (word_chars > 30 * n_words)::bigint as rule_bits from m
)
select *, (rule_bits & 3) <> 0 as base_failed, rule_bits = 0 as kept from b
"""

ABLATIONS = f"""
with l as ({ORACLE}), r(rule, bit) as (values {", ".join(f"('{name}', {1 << i}::bigint)" for i, (name, _) in enumerate(RULES))})
select rule, count(*) filter (rule_bits & bit <> 0)::bigint as failed, count(*) filter (rule_bits = bit)::bigint as only_this, count(*) filter (rule_bits in (0, bit))::bigint as kept_without from r cross join l group by rule
"""
