"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured and tested against its own rules.  The failures are then summed by host;
a host's failure rate is shrunk towards the rate of all hosts with a beta prior fitted to the hosts
themselves (method of moments), so that a host with few documents is not judged on chance; a host
whose shrunk rate is above a limit is rejected and takes its documents with it.

Defined results: a null text has no words and fails; a null host and an empty host are one host;
repeated rows are judged each on their own; an empty table gives an empty table; a text of any length is
measured whole (its words and windows are arrays in one row); ties in a host's rate are no matter, since a rate at
the limit passes; extra columns are kept by :func:`filter_documents` and don't clash, since own columns begin with ``_cs_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairnstore.llm.common import SEPARATORS, own_names_apart, staged, text_or_empty

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.6
SALTS = 16
FEW_HOSTS = 50_000

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    for separator in SEPARATORS[1:]:
        text = F.replace(text, F.lit(separator), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _windows(words: Column, mask: Column) -> Column:
    """Each 3-word window as a long, sorted: its hash in the bits of ``mask``, its place in the others.

    Equal windows are neighbours.  The places take as few bits as the text's length needs.
    """

    def packed(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(mask).bitwiseOR(i)

    return F.sort_array(F.slice(F.transform(words, packed), 1, F.greatest(F.size(words) - 2, F.lit(0))))


def _covered(windows: Column, words: Column, mask: Column) -> Column:
    """Words in a window that occurs twice or more.  All three must be columns: they are read for each element.

    Neighbours among the sorted windows are compared word for word.  If two different windows have one hash,
    equal ones might not be neighbours: the text's windows are then sorted by their words instead.
    """
    place = F.bitwise_not(mask)
    at = lambda k: F.get(windows, k).bitwiseAND(place).cast("int")
    last = F.size(windows) - 2
    pairs = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))

    def one_hash(k: Column) -> Column:
        return F.get(windows, k).bitwiseXOR(F.get(windows, k + 1)).bitwiseAND(mask) == 0

    def same_words(k: Column) -> Column:
        equal = F.lit(True)
        for step in range(3):
            equal = equal & (F.get(words, at(k) + step) == F.get(words, at(k + 1) + step))
        return equal

    twice = F.filter(pairs, lambda k: one_hash(k) & same_words(k))
    by_hash = F.flatten(F.transform(twice, lambda k: F.array(at(k), at(k + 1))))
    grams = F.sort_array(F.transform(windows, lambda w: _gram(words, w.bitwiseAND(place).cast("int"))))
    by_words = F.flatten(F.zip_with(
        grams, F.slice(grams, 2, F.greatest(F.size(grams) - 1, F.lit(0))), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>"))
    ))
    collided = F.exists(pairs, lambda k: one_hash(k) & ~same_words(k))
    return F.aggregate(
        F.sort_array(F.when(collided, by_words).otherwise(by_hash)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def _gram(words: Column, i: Column) -> Column:
    return F.struct(F.array(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the rule metrics and ``base_failed``; names get ``prefix``."""
    p = prefix
    own = docs.withColumn("_cs_text", text_or_empty()).withColumn("_cs_words", _words(F.col("_cs_text")))
    own = own.withColumn("_cs_lines", F.filter(F.split("_cs_text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")))
    own = own.withColumn("_cs_mask", F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(F.size("_cs_words")))))
    own = own.withColumn("_cs_windows", _windows(F.col("_cs_words"), F.col("_cs_mask")))
    text = F.col("_cs_text")
    own = own.withColumns({
        f"{p}n_words": F.size("_cs_words").cast("long"),
        f"{p}word_chars": F.length(F.array_join("_cs_words", "")).cast("long"),
        f"{p}n_symbols": (F.size(F.split(text, "[#*$%&|<>]")) - 1).cast("long"),
        f"{p}n_dup_lines": (F.size("_cs_lines") - F.size(F.array_distinct("_cs_lines"))).cast("long"),
        f"{p}n_repeat_words": _covered(F.col("_cs_windows"), F.col("_cs_words"), F.col("_cs_mask")),
    }).drop("_cs_text", "_cs_words", "_cs_lines", "_cs_mask", "_cs_windows")
    return own.withColumn(
        f"{p}base_failed",
        (F.col(f"{p}n_words") < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEATED_PERCENT * F.col(f"{p}n_words")),
    )


def host_verdicts(measured: DataFrame, host: str, failed: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures, the shrunk rate and the verdict.

    The prior's mean is the rate of all documents; its strength follows from how much more the
    hosts' rates vary than binomial chance allows.  Only two sums over the hosts reach the driver.
    """
    hosts = measured.groupBy(F.coalesce(F.col(host), F.lit("")).alias("_cs_host")).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(
        F.sum("host_docs").alias("n"), F.sum("host_failed").alias("f"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("host_docs") * rate * rate).alias("s2"),
    ).first()
    alpha, beta = beta_prior(total["n"] or 0, total["f"] or 0, total["h"], total["s2"] or 0.0)
    shrunk = (F.col("host_failed") + F.lit(alpha)) / (F.col("host_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= max_rate)


def beta_prior(n: int, f: int, hosts: int, s2: float) -> tuple[float, float]:
    """(alpha, beta) by the method of moments; ``s2`` is the sum of documents * rate^2 over hosts."""
    if not n:
        return 1.0, 1.0
    mean = f / n
    chance = mean * (1 - mean)
    spread = max(0.0, s2 / n - mean * mean)
    extra = spread - chance * hosts / n
    strength = min(max(chance / extra - 1, 2.0), 1000.0) if extra > 1e-12 and chance > 0 else 1000.0
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)


def join_verdicts(measured: DataFrame, hosts: DataFrame, host: str) -> DataFrame:
    """Adds the host columns.

    A table of at most ``FEW_HOSTS`` hosts, which is counted, is broadcast, and the texts stay where
    they are.  Beyond that a hot host's rows spread over ``SALTS`` copies of its verdict.
    """
    left = measured.withColumn("_cs_host", F.coalesce(F.col(host), F.lit("")))
    if hosts.count() <= FEW_HOSTS:
        return left.join(F.broadcast(hosts), "_cs_host").drop("_cs_host")
    salted = hosts.withColumn("_cs_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = left.withColumn("_cs_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return left.join(salted, ["_cs_host", "_cs_salt"]).drop("_cs_host", "_cs_salt")


def assess(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, the metrics, base_failed, host_rate and kept, for each row of ``docs``."""
    measured = staged(
        measure(docs.select("doc_id", "text", F.col(host).alias("host"))).select("doc_id", "host", *METRICS, "base_failed"), "quality"
    )
    hosts = staged(host_verdicts(measured, "host", "base_failed", max_host_rate), "hosts")
    judged = join_verdicts(measured, hosts, "host")
    return judged.select("doc_id", *METRICS, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


@own_names_apart
def filter_documents(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Rows are written with their flags and read back, so no text is shuffled and none is measured twice.
    """
    # Written before it is filtered: a filter pushed below the measures would evaluate them anew for every word.
    flagged = measure(docs.withColumn("_cs_source", F.col(host)), "_cs_").select(*docs.columns, "_cs_source", "_cs_base_failed")
    flagged = staged(flagged, "quality")
    hosts = staged(host_verdicts(flagged, "_cs_source", "_cs_base_failed", max_host_rate).select("_cs_host", F.col("host_ok").alias("_cs_ok")), "hosts")
    return join_verdicts(flagged.where(~F.col("_cs_base_failed")), hosts, "_cs_source").where("_cs_ok").select(*docs.columns)
