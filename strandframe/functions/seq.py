"""Column functions over sequence text and its coordinates.

All are compositions of built-in functions, evaluated in the JVM. Positions are 0-based and
half open. Null sequences give null. Case is data: lower case is soft-masked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of DNA text and their complements; ambiguity letters become N, padding stays.
DNA_LETTERS = "ACGTacgtNWSMKRYBDHVNZ "
DNA_COMPLEMENT = "TGCAtgcaNNNNNNNNNNNNN "
# The IUPAC complements.
IUPAC_LETTERS = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
IUPAC_COMPLEMENT = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
# The order of amino acid letters.
AMINO_LETTERS = "CKEWTGYAINVHSDFMRLPQ*"
# NCBI translation table 1, codons in the order TCAG.
_BASES, _AMINO = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}


def reverse_complement(seq: Column, iupac: bool = False) -> Column:
    return F.reverse(F.translate(seq, IUPAC_LETTERS if iupac else DNA_LETTERS, IUPAC_COMPLEMENT if iupac else DNA_COMPLEMENT))


def translate_frame(seq: Column, frame: int | Column = 0) -> Column:
    """Amino acids from letter `frame` on; codons outside the table (masked, unknown) give a blank."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    codons = F.regexp_extract_all(F.substring(seq, frame + 1, F.greatest(F.length(seq) - frame, F.lit(0))), F.lit("(?s)(...)"), F.lit(1))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(" "))), "")


def six_frames(seq: Column) -> Column:
    """Array of the three forward and three reverse-complement translations."""
    rc = reverse_complement(seq)
    return F.array(*[translate_frame(s, f) for s in (seq, rc) for f in range(3)])


def slice_local(seq: Column, start: Column, end: Column, rc: bool = False) -> Column:
    part = F.substring(seq, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))
    return reverse_complement(part) if rc else part


def slice_genomic(seq: Column, origin: Column, start: Column, end: Column) -> Column:
    """The part of a sequence that begins at `origin` which [start, end) covers; null if they are disjoint."""
    stop = origin + F.length(seq)
    a, b = F.greatest(start, origin), F.least(end, stop)
    return F.when((start < stop) & (end > origin), slice_local(seq, a - origin, b - origin))


def unmask_short_runs(seq: Column, longest: int) -> Column:
    """Upper-cases runs of lower case up to a length."""
    runs = F.regexp_extract_all(seq, F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[a-z]") & (F.length(r) <= longest), F.upper(r)).otherwise(r)), "")


def softmask(seq: Column, start: Column, length: Column, amino: bool = False) -> Column:
    """Lower-cases `length` letters from `start` on, clipped at the end; stops of amino acids become blanks there."""
    n = F.greatest(F.least(length, F.length(seq) - start), F.lit(0)).cast("int")
    start = start.cast("int")
    part = F.lower(F.substring(seq, start + 1, n))
    return F.concat(F.substring(seq, F.lit(1), start), F.translate(part, "*", " ") if amino else part, F.substring(seq, start + n + 1, F.length(seq)))


def browser_id(species: Column, chromosome: Column, start: Column, end: Column) -> Column:
    return F.concat(species, F.lit(":"), chromosome, F.lit(":"), F.format_number(start, 0), F.lit("-"), F.format_number(end, 0))


def parse_browser_id(ident: Column) -> dict[str, Column]:
    """species, chromosome, start and end of an id such as name:chr1:1,200-1,300."""
    pattern = r"^(.*):([^:]*):([0-9,]+)-([0-9,]+)$"
    number = lambda i: F.replace(F.regexp_extract(ident, pattern, i), F.lit(",")).try_cast("bigint")
    return {"species": F.regexp_extract(ident, pattern, 1), "chromosome": F.regexp_extract(ident, pattern, 2), "start": number(3), "end": number(4)}


def state_string(left: Column, exon: Column, right: Column, reverse: Column) -> Column:
    """l…E…r over a sequence; the flanks swap on the reverse strand."""
    a, b = F.when(reverse, right).otherwise(left), F.when(reverse, left).otherwise(right)
    return F.concat(F.repeat(F.lit("l"), a.cast("int")), F.repeat(F.lit("E"), exon.cast("int")), F.repeat(F.lit("r"), b.cast("int")))


def kmers(seq: Column, k: int) -> Column:
    """Array of all windows of k letters, in order; empty if the text is shorter. Linear in the text: a look-ahead matches at every letter."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


# ---- coordinates

def flip(pos: Column, length: Column) -> Column:
    """Position on the other strand; its own inverse. Out of range is null."""
    return F.when((pos >= 0) & (pos < length), length - pos - 1)


def dna_to_frame(pos: Column) -> Column:
    return F.pmod(pos, F.lit(3))


def dna_to_amino(pos: Column) -> Column:
    return F.floor((pos - F.pmod(pos, F.lit(3))) / 3).cast("bigint")


def amino_to_dna(frame: Column, pos: Column) -> Column:
    return 3 * pos + frame


def amino_range(frame: Column, start: Column, end: Column, partial: bool) -> tuple[Column, Column]:
    """Half-open amino acid range of a half-open DNA range: codons touched (partial) or wholly inside."""
    low = F.floor if partial else F.ceil
    high = F.ceil if partial else F.floor
    a = F.greatest(low((start - frame) / 3), F.lit(0)).cast("bigint")
    return a, F.greatest(high((end - frame) / 3).cast("bigint"), a)


def site_on_dna(length: Column, frame: Column, raw: Column, site: Column) -> dict[str, Column]:
    """Top-strand place of a site found in a DNA frame (0 forward, 1 reverse complement), clipped at the end."""
    n = F.least(site, length - raw)
    return {"position": F.when(frame == 0, raw).otherwise(length - (raw + n)), "strand": F.when(frame == 0, F.lit("+")).otherwise(F.lit("-")), "site_len": n}


def amino_site_on_dna(dna_length: Column, frame: Column, raw: Column, site: Column) -> dict[str, Column]:
    """Top-strand place of a site found in one of six translated frames."""
    shift = F.pmod(frame, F.lit(3))
    residues = F.floor((dna_length - shift) / 3).cast("bigint")
    n = F.least(site, residues - raw)
    forward = frame < 3
    return {
        "position": F.when(forward, 3 * raw + shift).otherwise(dna_length - (3 * (raw + n) + shift)),
        "strand": F.when(forward, F.lit("+")).otherwise(F.lit("-")),
        "site_len": 3 * n,
    }


def anchors(chrom_start: Column, sizes: Column, starts: Column, i: Column, left_len: int, right_len: int, middle_len: int) -> dict[str, Column]:
    """Anchor geometry of the i-th block (0-based, an inner one) of a transcript."""
    size, begin = lambda d: F.element_at(sizes, (i + 1 + d).cast("int")), lambda d: F.element_at(starts, (i + 1 + d).cast("int"))
    start, stop = chrom_start + begin(0), chrom_start + begin(0) + size(0)
    left_intron, right_intron = begin(0) - begin(-1) - size(-1), begin(1) - begin(0) - size(0)
    left_start, right_start = start - left_intron - left_len, stop + right_intron
    middle = F.floor((stop + start - middle_len) / 2).cast("bigint")
    return {
        "exon_start": start, "exon_stop": stop, "left_intron_len": left_intron, "right_intron_len": right_intron, "left_anchor_start": left_start, "left_anchor_end": left_start + left_len,
        "right_anchor_start": right_start, "right_anchor_end": right_start + right_len, "substring_len": right_start - (left_start + left_len),
        "total_len": right_start + right_len - left_start, "middle_start": middle, "middle_end": middle + middle_len,
    }
