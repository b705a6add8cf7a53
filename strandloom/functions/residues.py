"""Column functions on sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in the order T C A G of their three letters.
CODE_1 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Further genetic codes by their number, in the same order.
CODES = {
    1: CODE_1,
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: CODE_1,
}
_BASES = "TCAG"
#: A fixed map of letters to bases, for nucleotide fixtures made of prose.
LETTERS, AS_BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def letters(text: Column) -> Column:
    """ASCII letters of a text, upper-cased."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]+", ""))


def with_letters(text: Column) -> Column:
    """Whether a text has any; told by the first, long before they are all gathered."""
    return F.coalesce(text.rlike("[A-Za-z]"), F.lit(False))


def as_bases(residues: Column) -> Column:
    return F.translate(residues, LETTERS, AS_BASES)


def assembled(pieces: Column) -> Column:
    """A sequence from an array of pieces (residues, gap): each piece's residues, or a run of N as long as its gap."""
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(p["residues"], F.repeat(F.lit("N"), p["gap"]))), "")


def masked(residues: Column, which: str) -> Column:
    """Every one of the letters ``which`` becomes X."""
    return F.translate(residues, which, "X" * len(which)) if which else residues


def clean_protein(residues: Column) -> Column:
    """Upper case without white space; what is no residue code becomes X."""
    return F.regexp_replace(F.upper(F.regexp_replace(residues, r"\s", "")), "[^A-Z*-]", "X")


def clean_bases(residues: Column) -> Column:
    """Upper case without white space, U as T; ambiguous bases become N."""
    return F.regexp_replace(F.translate(F.upper(F.regexp_replace(residues, r"\s", "")), "U", "T"), "[^ACGT]", "N")


def from_2na(packed: Column, length: Column) -> Column:
    """Bases of a binary column with four bases a byte, first base in the high bits."""
    pairs = F.lower(F.hex(packed))
    # Two steps, so that no letter that was put in is taken for a digit again.
    pairs = F.translate(pairs, "0123456789abcdef", "ijklmnopqrsuvwxy")
    for i, c in enumerate("ijklmnopqrsuvwxy"):
        pairs = F.replace(pairs, F.lit(c), F.lit("ACGT"[i >> 2] + "ACGT"[i & 3]))
    return F.left(pairs, length)


def reverse_complement(bases: Column) -> Column:
    return F.translate(F.reverse(bases), "ACGTRYKMBDHV", "TGCAYRMKVHDB")


def codon_map(code: str = CODE_1) -> Column:
    pairs = [(a + b + c, code[16 * i + 4 * j + k]) for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def translated(bases: Column, frame: int, code: str = CODE_1) -> Column:
    """Protein of a frame (1, 2, 3, -1, -2, -3); codons that are not in the code become X."""
    strand = bases if frame > 0 else reverse_complement(bases)
    codons = F.regexp_extract_all(F.substring(strand, F.lit(abs(frame)), F.greatest(F.length(bases), F.lit(0))), F.lit("[A-Z]{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(codon_map(code), c), F.lit("X"))), "")


def frame_of(context: Column) -> Column:
    """Frame of a context: 0 to 5 stand for 1, 2, 3, -1, -2, -3."""
    return F.when(context < 3, context + 1).otherwise(2 - context)


def to_bases_offset(position: Column, frame: Column, length: Column) -> Column:
    """Position on the bases where a residue of a frame begins; for minus frames counted from the far end."""
    return F.when(frame > 0, position * 3 + frame - 1).otherwise(position * 3 + length - frame)


def bases_range(start: Column, end: Column, frame: Column, length: Column) -> Column:
    """[from, to) on the plus strand that residues [start, end) of a frame cover."""
    lo, hi = start * 3 + F.abs(frame) - 1, end * 3 + F.abs(frame) - 1
    return F.when(frame > 0, F.struct(lo.alias("from"), hi.alias("to"))).otherwise(F.struct((length - hi).alias("from"), (length - lo).alias("to")))


def residue_range(start: Column, end: Column, frame: Column, length: Column) -> Column:
    """Residues of a frame that bases [start, end) touch; for minus frames counted from the far end."""
    lo = F.when(frame > 0, start).otherwise(length - end)
    hi = F.when(frame > 0, end).otherwise(length - start)
    return F.struct(F.floor(lo / 3).cast("int").alias("from"), F.floor(hi / 3).cast("int").alias("to"))


def round_up_16(n: Column) -> Column:
    return (F.ceil(n / 16) * 16).cast("long")


def size_in_bytes(text: Column) -> Column:
    """Bytes that a size like 500MB or 2 GB stands for; null if it is none."""
    found = lambda g: F.regexp_extract(F.upper(text), r"^\s*([0-9]+)\s*([KMGT]?)B?\s*$", g)
    power = F.element_at(F.create_map(*[F.lit(x) for p in (("", 1), ("K", 1 << 10), ("M", 1 << 20), ("G", 1 << 30), ("T", 1 << 40)) for x in p]), found(2))
    return F.when(found(1) != "", found(1).try_cast("long") * power)


def location(text: Column) -> Column:
    """(from, to), zero-based and half-open, of a location like 11-200; to is null for an open end."""
    first, last = F.regexp_extract(text, "^([0-9]+)-([0-9]*)$", 1), F.regexp_extract(text, "^([0-9]+)-([0-9]*)$", 2)
    return F.struct((first.try_cast("int") - 1).alias("from"), last.try_cast("int").alias("to"))


def restricted(residues: Column, loc: str) -> tuple[Column, int]:
    """The part of a sequence at a location, and what to add to its coordinates."""
    first, _, last = loc.partition("-")
    start = int(first)
    if start < 1 or (last and int(last) < start):
        raise ValueError(f"no location: {loc}")
    return F.substring(residues, F.lit(start), F.lit(int(last) - start + 1) if last else F.length(residues)), start - 1


def defline_id(line: Column) -> Column:
    """The id of a title line: its first word, without bars at the ends."""
    return F.regexp_extract(line, r"^>?\s*(\S+)", 1)


def defline_title(line: Column) -> Column:
    return F.regexp_extract(line, r"^>?\s*\S+\s+(.*)$", 1)


def from_4na(packed: Column, length: Column) -> Column:
    """Bases of a binary column with two bases a byte, each a set of A, C, G and T in four bits."""
    return F.left(F.translate(F.lower(F.hex(packed)), "0123456789abcdef", "-ACMGRSVTWYHKDBN"), length)


def from_stdaa(packed: Column) -> Column:
    """Residues of a binary column with a residue code in each byte; bytes that are none become X."""
    known = F.translate(F.decode(packed, "ISO-8859-1"), "".join(map(chr, range(28))), "-ABCDEFGHIKLMNPQRSTVWXYZU*OJ")
    return F.regexp_replace(known, "[^A-Z*-]", "X")


def from_eaa(text: Column) -> Column:
    """Residues of extended letters, which are text already: upper case, and what is no residue becomes X."""
    return clean_protein(text)
