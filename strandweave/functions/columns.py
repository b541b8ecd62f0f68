"""Column expressions: flags, intervals, CIGAR, DNA, statistics and record text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bits of the SAM flag field
MULTIPLE, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
FIRST, LAST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x40, 0x80, 0x100, 0x200, 0x400, 0x800

# fixed values: orientations of a breakpoint
LARGE, SMALL, SWAPPED, INVERTED, NOT_DECIDED, CLIPPED = range(6)

#: Added to depths before logarithms and divisions.
EPSILON = 1e-10
#: Positions in a genomic bin.
BIN = 1000


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- flags -----------------------------------------------------------------


def has_flag(flag: Column | str, mask: int) -> Column:
    """All bits of ``mask`` are set."""
    return c(flag).bitwiseAND(mask) == mask


def usable(flag: Column | str) -> Column:
    """Mapped, passed quality checks and not secondary; duplicates are kept."""
    return c(flag).bitwiseAND(UNMAPPED | SECONDARY | QC_FAIL) == 0


def read_end_name(qname: Column | str, flag: Column | str) -> Column:
    """A read's name with the end of the pair that it is."""
    return F.concat(c(qname).cast("string"), F.when(has_flag(flag, FIRST), "/1").otherwise("/2"))


def discordant(flag: Column, mate_reverse: Column, reverse: Column, tlen: Column, map_q: Column, min_q: int, max_insert: Column) -> Column:
    """A pair with a mapped mate whose size, strands or order aren't those of a proper one."""
    size = F.abs(tlen) > max_insert
    order = ((tlen > 0) & reverse) | ((tlen < 0) & ~reverse)
    return (map_q >= min_q) & ~has_flag(flag, MATE_UNMAPPED) & (size | (reverse == mate_reverse) | order)


# --- intervals ---------------------------------------------------------------


def widened(begin: Column | str, end: Column | str, by: int, limit: Column | None = None) -> tuple[Column, Column]:
    """An interval with ``by`` more on either side, clamped at 0 and at ``limit``."""
    hi = c(end) + by
    return F.greatest(c(begin) - by, F.lit(0)), hi if limit is None else F.least(hi, limit)


def overlaps(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Closed intervals that share a position."""
    return (b1 <= e2) & (b2 <= e1)


def adjacent_points(a: Column, b: Column, tol: int) -> Column:
    return F.abs(a - b) <= tol


def adjacent(b1: Column, e1: Column, b2: Column, e2: Column, tol: int) -> Column:
    """Disjoint intervals with a gap of at most ``tol``."""
    return ~overlaps(b1, e1, b2, e2) & (F.greatest(b1, b2) - F.least(e1, e2) <= tol)


def reciprocal(b1: Column, e1: Column, b2: Column, e2: Column, share: float) -> Column:
    """The overlap makes up ``share`` of both intervals."""
    both = F.least(e1, e2) - F.greatest(b1, b2) + 1
    return (both >= share * (e1 - b1 + 1)) & (both >= share * (e2 - b2 + 1)) & overlaps(b1, e1, b2, e2)


def valid(begin: Column, end: Column) -> Column:
    return begin.isNotNull() & end.isNotNull() & (begin <= end)


def bin_of(pos: Column | str, size: int = BIN) -> Column:
    return F.floor(c(pos) / size).cast("long")


# --- CIGAR ---------------------------------------------------------------------


def cigar_ops(text: Column | str) -> Column:
    """A CIGAR text as an array of (count, op)."""
    each = F.regexp_extract_all(c(text), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(each, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("count"), F.substring(x, -1, 1).alias("op")))


def ref_length(ops: Column) -> Column:
    """Length on the reference: all but soft clips, hard clips and insertions."""
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin("S", "H", "I"), 0).otherwise(o["count"]))


def edge_clip(ops: Column, least: int) -> Column:
    """The first or the last operation clips ``least`` bases or more."""
    big = lambda o: o["op"].isin("S", "H") & (o["count"] >= least)
    return F.coalesce(big(F.get(ops, F.lit(0))) | big(F.get(ops, F.size(ops) - 1)), F.lit(False))


def inner_gap(ops: Column, least: int) -> Column:
    """An operation between the first and the last skips, inserts or deletes ``least`` bases or more."""
    return F.exists(F.slice(ops, F.lit(2), F.greatest(F.size(ops) - 2, F.lit(0))), lambda o: o["op"].isin("P", "I", "D", "N") & (o["count"] >= least))


def cigar_spans(begin: Column, ops: Column, min_sv: int, min_clip: int, double_deletion: bool = False) -> Column:
    """Reference end, query span and size, deletions and clips as arrays of (left, right), from ``ops``, a column of its own.

    A deletion's right end follows its bases; with ``double_deletion`` those
    bases move what follows a second time. A left clip knows its right
    position only, a right clip its left one. Sums and the edges tell all but
    the deletions; only where there are any do operations follow one another.
    """
    pair = "array<struct<left:bigint,right:bigint>>"
    zero, none, start, empty = F.lit(0).cast("long"), F.lit(None).cast("long"), begin.cast("long"), F.array().cast(pair)
    first, last = F.get(ops, F.lit(0)), F.get(ops, F.size(ops) - 1)
    gone = lambda o: o["op"].isin("D", "N") & (o["count"] >= min_sv)
    soft = lambda o: (o["op"] == "S") & (o["count"] >= min_clip)
    total = lambda *kinds: F.aggregate(ops, zero, lambda a, o: a + F.when(o["op"].isin(*kinds), o["count"]).otherwise(0))

    def moved(o: Column) -> Column:
        n = F.when(o["op"].isin("M", "=", "X", "D", "N"), o["count"].cast("long")).otherwise(0)
        return n + F.when(gone(o), o["count"]).otherwise(0) if double_deletion else n

    def found(a: Column, o: Column) -> Column:
        one = F.array(F.struct(a["end"].alias("left"), (a["end"] + o["count"]).alias("right")))
        return F.struct((a["end"] + moved(o)).alias("end"), F.when(gone(o), F.concat(a["found"], one)).otherwise(a["found"]).alias("found"))

    ref_end = start + F.aggregate(ops, zero, lambda a, o: a + moved(o))
    # the query begins after the clip that is its first operation, if that is one
    head = F.when(first["op"].isin("D", "N"), F.get(F.filter(ops, lambda o: ~o["op"].isin("D", "N")), F.lit(0))).otherwise(first)
    q_begin = F.when(head["op"].isin("S", "H"), head["count"].cast("long")).when(head.isNotNull(), zero)
    return F.struct(
        ref_end.alias("ref_end"),
        q_begin.alias("q_begin"),
        (q_begin + total("M", "=", "X", "P", "I")).alias("q_end"),
        total("M", "=", "X", "P", "I", "S", "H").alias("q_size"),
        F.when(F.exists(ops, gone), F.aggregate(ops, F.struct(start.alias("end"), empty.alias("found")), found)["found"]).otherwise(empty).alias("deletions"),
        F.concat(
            F.when(soft(first), F.array(F.struct(none.alias("left"), start.alias("right")))).otherwise(empty),
            F.when((F.size(ops) > 1) & soft(last), F.array(F.struct((ref_end - 1).alias("left"), none.alias("right")))).otherwise(empty),
        ).alias("clips"),
    )


# --- DNA -----------------------------------------------------------------------


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(c(seq), "ACGTacgt", "TGCAtgca"))


def base_count(seq: Column | str, base: str) -> Column:
    return F.length(c(seq)) - F.length(F.replace(F.upper(c(seq)), F.lit(base)))


def gc_content(seq: Column | str) -> Column:
    """Share of G and C in all bases, unknown ones included; null for an empty sequence."""
    return F.try_divide((base_count(seq, "G") + base_count(seq, "C")).cast("double"), F.length(c(seq)))


def base_entropy(seq: Column | str) -> Column:
    """Shannon entropy in bits of the shares of A, C, G and T; an absent base adds nothing."""
    total = sum((base_count(seq, b) for b in "CGT"), base_count(seq, "A"))
    terms = [F.try_divide(base_count(seq, b).cast("double"), total) for b in "ACGT"]
    term = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    return sum((term(p) for p in terms[1:]), term(terms[0]))


# --- statistics ------------------------------------------------------------------


def index_quantile(value: str, q: float) -> Column:
    """The element floor(n q) of the sorted values: of the median, the upper one. Aggregates map-side by value."""
    return F.expr(f"percentile_disc({1 - q}) WITHIN GROUP (ORDER BY {value} DESC)")


def poisson_divergence(p0: Column | str, p1: Column | str) -> Column:
    """Kullback-Leibler divergence of two Poisson means, at least 0."""
    a, b = c(p0) + EPSILON, c(p1) + EPSILON
    return F.greatest(a - b + b * F.log(b / a), F.lit(0.0))


def poisson_pmf(k: Column | str, rate: Column | str) -> Column:
    return F.pow(c(rate), c(k)) * F.exp(-c(rate)) / F.factorial(c(k))


# --- record text -------------------------------------------------------------------


def info_map(info: Column | str) -> Column:
    """``k=v;flag;...`` as a map; a flag's value is empty."""
    return F.str_to_map(c(info), F.lit(";"), F.lit("="))


def info_value(info: Column, key: str, kind: str) -> Column:
    return F.try_element_at(info, F.lit(key)).try_cast(kind)


def six(x: Column | str) -> Column:
    """A double with six decimals, as records write it."""
    return F.format_string("%.6f", c(x).cast("double"))


#: Statuses that a record's FILTER may name.
STATUSES = ("PASS", "FILTERED", "MERGED")


def status_text(status: Column | str) -> Column:
    """FILTER of a status: one of the three, and FILTERED for any other or none."""
    return F.when(c(status).isin(*STATUSES), c(status)).otherwise("FILTERED")


def breakend_alt(same_strand: Column, chrom: Column, pos: Column, first: bool) -> Column:
    """Bracket notation of one of the two records of a breakend; ``pos`` counts from 0."""
    at = F.concat(chrom, F.lit(":"), (pos + 1).cast("string"))
    if first:
        return F.when(same_strand, F.concat(F.lit("N["), at, F.lit("["))).otherwise(F.concat(F.lit("N]"), at, F.lit("]")))
    return F.when(same_strand, F.concat(F.lit("]"), at, F.lit("]N"))).otherwise(F.concat(F.lit("["), at, F.lit("[N")))
