"""The k-mer functions as Catalyst columns; the vectorised kernel is checked against them.

A code has three bits a base. Up to k = 21 it is one long below 2^63; beyond, up to 42, it is two (high, low) of which high * 2^64 + low is the code,
low in two's complement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import BASE_CODES, MIX_1, ONE_LIMB_K

_LETTERS = "".join(BASE_CODES)


def encode_base(base: Column) -> Column:
    """A letter's code: 1, 6, 3, 4 for A, C, G, T in either case, else -1."""
    out = F.lit(-1)
    for letter, code in BASE_CODES.items():
        out = F.when(F.upper(base) == letter, code).otherwise(out)
    return out


def revcomp(kmer: Column) -> Column:
    return F.reverse(F.translate(F.upper(kmer), "ACGT", "TGCA"))


def code_digits(kmer: Column) -> Column:
    """A k-mer as octal digits; comparing two of the same length compares their codes."""
    return F.translate(F.upper(kmer), _LETTERS, "".join(map(str, BASE_CODES.values())))


def kmer_code(kmer: Column) -> Column:
    """The code as a number, the first base in the high bits (k up to 21)."""
    return F.conv(code_digits(kmer), 8, 10).cast("long")


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer's and its reverse complement's codes."""
    return F.least(kmer_code(kmer), kmer_code(revcomp(kmer)))


def code_limbs(digits: Column, k: int) -> tuple[Column, Column]:
    """(high, low) of k octal digits: the last 21 fill 63 bits, the rest go on from bit 63."""
    below = F.conv(F.substring(digits, max(1, k - 20), min(k, ONE_LIMB_K)), 8, 10).cast("long")
    if k <= ONE_LIMB_K:
        return F.lit(0).cast("long"), below
    above = F.conv(F.substring(digits, 1, k - ONE_LIMB_K), 8, 10).cast("long")
    return F.shiftrightunsigned(above, 1), F.shiftleft(above, 63).bitwiseOR(below)


def canonical_digits(kmer: Column) -> Column:
    """The octal digits of the lesser of a k-mer's and its reverse complement's codes, for any k."""
    return F.least(code_digits(kmer), code_digits(revcomp(kmer)))


def canonical_limbs(kmer: Column, k: int) -> tuple[Column, Column]:
    """(high, low) of the lesser of a k-mer's and its reverse complement's codes."""
    return code_limbs(canonical_digits(kmer), k)


def simplicity(kmer: Column) -> Column:
    """The sum of squared base counts."""
    total = F.lit(0)
    for letter in _LETTERS:
        n = F.length(kmer) - F.length(F.replace(F.upper(kmer), F.lit(letter), F.lit("")))
        total = total + n * n
    return total.cast("int")


def _halves(x: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))


def _digits_of_product(x: Column, multiplier: int, places: int) -> list[Column]:
    """The lowest digits, of 16 bits, of x * multiplier, both unsigned. Products are of 16 by 32 bits, so that no step overflows a signed long."""
    h1, h0 = _halves(x)
    m = [multiplier >> (16 * k) & 0xFFFF for k in range(4)]
    digits = []
    carry = F.lit(0).cast("long")
    for place in range(min(places, 6)):  # column sums of digits: h0 * m[k] lies at k, h1 * m[k] at k + 2
        total = carry
        if place < 4:
            total = total + h0 * m[place]
        if 0 <= place - 2 < 4:
            total = total + h1 * m[place - 2]
        digits.append(total.bitwiseAND(F.lit(0xFFFF)))
        carry = F.shiftrightunsigned(total, 16)
    return digits + [carry.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(carry, 16)][: max(0, places - 6)]


def _word_of(digits: list[Column]) -> Column:
    out = digits[0]
    for k in (1, 2, 3):
        out = out.bitwiseOR(F.shiftleft(digits[k], 16 * k))
    return out


def mix_hash(code: Column, multiplier: int, high: Column | None = None) -> Column:
    """lo64(p) xor hi64(p) of p = (code xor MIX_1) * multiplier, as a two's-complement long; code below 2^63.

    With high, code is the low limb of a code of two: MIX_1 meets it alone, and the product of high goes to the upper half, modulo 2^64.
    """
    signed = MIX_1 - (1 << 64) if MIX_1 >> 63 else MIX_1
    digits = _digits_of_product(code.bitwiseXOR(F.lit(signed)), multiplier, 8)
    upper = digits[4:]
    if high is not None:
        carry, total = F.lit(0).cast("long"), []
        for a, b in zip(upper, _digits_of_product(high, multiplier, 4), strict=True):
            both = a + b + carry
            total.append(both.bitwiseAND(F.lit(0xFFFF)))
            carry = F.shiftrightunsigned(both, 16)
        upper = total
    return _word_of(digits[:4]).bitwiseXOR(_word_of(upper))
