"""Column expressions over DNA strings. All stay inside the JVM; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Two bits for each base, in code order.
_CODES = ("ACGT", "0123")


def complement(seq: Column) -> Column:
    """A <-> T, C <-> G after upper-casing; other characters stay."""
    return F.translate(F.upper(seq), "ACGT", "TGCA")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def share_over(seq: Column, base: str, share: float) -> Column:
    """Whether a base makes up more than a share of the sequence."""
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit(""))) > share * F.length(seq)


def low_complexity(seq: Column, share: float) -> Column:
    """Too many As or too many Ts."""
    return share_over(seq, "A", share) | share_over(seq, "T", share)


def has_n(seq: Column) -> Column:
    return F.instr(seq, "N") > 0


def discard_read(seq: Column, share: float = 0.7) -> Column:
    return has_n(seq) | low_complexity(seq, share)


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement; byte order is code order."""
    return F.least(kmer, revcomp(kmer))


def encode(kmer: Column) -> Column:
    """k-mer text to two bits a base, in any case; null if a character is none of the four."""
    up = F.upper(kmer)
    digits = up
    for base, digit in zip(*_CODES):  # four passes over bytes, where translate() looks each character up in a map
        digits = F.replace(digits, F.lit(base), F.lit(digit))
    return F.when(up.rlike("^[ACGT]+$"), F.conv(digits, 4, 10).cast("long"))


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def decode(code: Column, k: int) -> Column:
    """The text of a number of two bits a base. Up to 16 bases at a time are spread to hexadecimal digits: A, C, and E and F for G and T."""
    left = lambda x, n: F.call_function("shiftleft", x, F.lit(n))
    right = lambda x, n: F.call_function("shiftrightunsigned", x, F.lit(n))
    parts = []
    for done in range(0, k, 16):
        n = min(16, k - done)
        x = right(code.cast("long"), 2 * (k - done - n)).bitwiseAND(_long((1 << 2 * n) - 1))
        for step in (16, 8, 4, 2):
            x = x.bitwiseOR(left(x, step)).bitwiseAND(_long(sum(((1 << step) - 1) << 2 * step * i for i in range(32 // step))))
        ones = ((1 << 4 * n) - 1) // 15
        low, high = x.bitwiseAND(_long(ones)), right(x, 1).bitwiseAND(_long(ones))
        digit = _long(8 * ones).bitwiseOR(left(high.bitwiseOR(low), 2)).bitwiseOR(left(high.bitwiseOR(low.bitwiseXOR(_long(ones))), 1)).bitwiseOR(high.bitwiseAND(low))
        parts.append(F.hex(digit))
    return F.replace(F.replace(F.concat(*parts), F.lit("E"), F.lit("G")), F.lit("F"), F.lit("T"))


def log_sum_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); minus infinity is neutral."""
    low = F.lit(float("-inf"))
    return F.when(a == low, b).when(b == low, a).otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))


def logistic(x: Column, middle: float = 3.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(middle) - x))


def multi_weight(multi: Column) -> Column:
    """The weight of a read hit `multi` times: every read counts once."""
    return F.lit(1.0)


def overlap_infix(seq: Column, loc: Column, core_len: Column, margin: int = 2) -> Column:
    """The part of an oriented read over the core, without the margin at the core's ends."""
    start = F.greatest(F.lit(0), margin - loc)
    stop = F.least(F.length(seq), core_len - loc - margin)
    return F.when(stop > start, F.substring(seq, start + 1, stop - start)).otherwise("")


#: The fourth N of a chain in which neighbours are at most three other characters apart ends the read.
N_CHAIN = "^(.*?N[^N]{0,3}N[^N]{0,3}N[^N]{0,3}N)"


def n_cut_at(seq: Column) -> Column:
    """0-based place of the N that ends the read, -1 if none does."""
    return F.length(F.regexp_extract(F.upper(seq), N_CHAIN, 1)) - 1


def n_masked(seq: Column, keep_over: int = 35) -> Column:
    """The read, cut before the ending N if that lies beyond keep_over; null if the read is to be rejected."""
    at = n_cut_at(seq)
    return F.when(at < 0, seq).when(at > keep_over, F.substring(seq, F.lit(1), at))


def substitute_n(seq: Column, read_id: Column) -> Column:
    """Each N (any case) becomes a base chosen by the read's id and the place, the same on every run."""
    def base(c: Column, i: Column) -> Column:
        pick = F.substring(F.lit(BASES), (F.pmod(read_id * 31 + i * 7 + F.call_function("div", read_id, F.lit(13)), F.lit(4)) + 1).cast("int"), F.lit(1))
        return F.when(F.upper(c) == "N", pick).otherwise(c)

    return F.when(F.instr(F.upper(seq), "N") == 0, seq).otherwise(F.array_join(F.transform(F.split(seq, "(?!^)"), base), ""))


def column_profile(a: Column, c: Column, g: Column, t: Column, psi: float = 0.01) -> dict[str, Column]:
    """Probabilities with a pseudocount, entropy in nats, and the letter of the first largest (in the order A, C, G, T)."""
    n = a + c + g + t
    p = {b: (x + psi) / (n + 4 * psi) for b, x in zip(BASES, (a, c, g, t))}
    h = -(p["A"] * F.log(p["A"]) + p["C"] * F.log(p["C"]) + p["G"] * F.log(p["G"]) + p["T"] * F.log(p["T"]))
    top = F.greatest(a, c, g, t)
    letter = F.when(a == top, "A").when(c == top, "C").when(g == top, "G").otherwise("T")
    return {"pA": p["A"], "pC": p["C"], "pG": p["G"], "pT": p["T"], "entropy": h, "letter": letter}
