"""Column functions on sequences: normal forms, ids, trims, masks, codes, strands, pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue and nucleotide codes, complements.
AMINO_CODES = {c: i for i, c in enumerate("ARNDCQEGHILKMFPSTWYV")} | {"B": 2, "Z": 6, "J": 20, "O": 20, "U": 20, "X": 20}
NUCLEOTIDE_CODES = {"A": 0, "C": 1, "G": 2, "T": 3, "U": 3}
COMPLEMENT = ("ACGTUacgtu", "TGCAAtgcaa")
MASK = "#"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(seq: str | Column, checked: bool = False) -> Column:
    """Trailing white space and one final ``*`` off, blanks out, upper case; null where :func:`is_valid` is false. ``checked``: rows that aren't valid are out already."""
    bare = F.upper(F.regexp_replace(_col(seq), r"[\s*]+", ""))
    return bare if checked else F.when(is_valid(seq), bare)


def is_valid(seq: str | Column) -> Column:
    """Only letters and white space, but for one final ``*``."""
    return F.rlike(_col(seq), F.lit(r"^[A-Za-z\s]*+\*?\s*+\z"))


def has_letters(seq: str | Column, n: int) -> Column:
    """Whether a valid sequence has ``n`` letters; no more of it is looked at."""
    return F.rlike(_col(seq), F.lit(rf"^\s*+(?:[A-Za-z]\s*+){{{n}}}"))


def letters_only(seq: str | Column) -> Column:
    return F.upper(F.regexp_replace(_col(seq), "[^A-Za-z]", ""))


def as_nucleotides(seq: str | Column) -> Column:
    """Any upper-case text over the four bases, letter by letter."""
    return F.translate(_col(seq), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("ACGT" * 7)[:26])


def short_id(defline: str | Column, width: int = 0) -> Column:
    """The id of a definition line: its marker and one blank off, up to white space; ``width`` counts the marker too, 0 is no limit."""
    bare = F.regexp_extract(F.regexp_replace(_col(defline), r"^[>@+]? ?", ""), r"^\S*", 0)
    return F.substring(bare, 1, width - 1) if width else bare


def long_enough(seq: str | Column, least: int = 10) -> Column:
    """Longer than ``least``; with two mates add their lengths first."""
    return F.length(_col(seq)) > least


def trim(seq: str | Column, keep: int) -> Column:
    return F.substring(_col(seq), 1, keep) if keep > 0 else _col(seq)


def encode_nucleotides(seq: str | Column) -> Column:
    """Digits 0-3, 4 for any other letter, 5 for masked ones."""
    others = "BDEFHIJKLMNOPQRSVWXYZ"
    return F.translate(_col(seq), "ACGTU" + others + MASK, "01233" + "4" * len(others) + "5")


def encode_residues(seq: str | Column) -> Column:
    """Letters a-u in the order of the residue codes, so that word order is string order."""
    names = sorted(AMINO_CODES)
    return F.translate(_col(seq), "".join(names), "".join(chr(ord("a") + AMINO_CODES[c]) for c in names))


def mask(seq: str | Column, letters: str) -> Column:
    return F.translate(_col(seq), letters.upper(), MASK * len(letters))


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(_col(seq), *COMPLEMENT))


def merge_mates(r1: str | Column, r2: str | Column) -> Column:
    """R2 read backwards, then R1."""
    return F.concat(F.reverse(_col(r2)), _col(r1))


def pad_and_join(r1: str | Column, r2: str | Column, width: int | Column) -> Column:
    """Each mate cut or padded with N to ``width``, then joined."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.rpad(_col(r1), w, F.lit("N")), F.rpad(_col(r2), w, F.lit("N")))


def upper_length(length: str | Column, s: float = 0.0, S: int = 99999999, aL: float = 0.0, AL: int = 99999999) -> Column:
    """The longest representative that a sequence may join."""
    share, gap = max(s, aL), min(S, AL)
    by_share = F.floor(_col(length).cast("float") / F.lit(share)).cast("long") if share > 0 else F.lit(99999999)
    by_gap = _col(length) + F.lit(gap) if gap < 99999999 else F.lit(99999999)
    return F.least(by_share, by_gap).cast("long")


def lower_length(length: str | Column, s2: float = 1.0, S2: int = 0) -> Column:
    """The shortest first-set sequence that a second-set sequence may join."""
    return F.least(_col(length) - F.lit(S2), F.floor(_col(length) * F.lit(s2))).cast("long")


def coverage_minimum(length: str | Column, share: float, gap: int = 99999999, least: int = 0) -> Column:
    """Letters that an alignment must cover of a sequence."""
    return F.greatest(F.floor(_col(length) * F.lit(share)), _col(length) - F.lit(gap), F.lit(least)).cast("long")


def common_prefix_length(a: str | Column, b: str | Column) -> Column:
    """Letters up to the first difference."""
    a, b = _col(a), _col(b)
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True)
    return F.when(at == 0, F.length(a)).otherwise(at - 1).cast("long")


def mismatches(a: str | Column, b: str | Column) -> Column:
    """Places at which two strings of the same length differ; more letters of the longer one count too."""
    pairs = F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x).cast("long")


def taxon(lineage: str | Column, rank: str) -> Column:
    """A field of ``k__..;p__..;..`` or ``D_0__..;D_1__..`` lineages; empty fields are null."""
    ranks = "kpcofgs"
    plain = F.regexp_extract(_col(lineage), rf"(?:^|;)\s*(?:{rank}__|D_{ranks.index(rank)}__)([^;|]*)", 1)
    return F.nullif(plain, F.lit(""))


def species_name(genus: Column, species: Column) -> Column:
    """A species carries its genus in front unless it does so already."""
    return F.when(species.isNull() | genus.isNull() | F.startswith(species, genus), species).otherwise(F.concat_ws("_", genus, species))


def abundance(descr: str | Column) -> Column:
    """The number after ``_abundance_``, or 1."""
    found = F.regexp_extract(_col(descr), r"_abundance_(\d+)", 1)
    return F.when(found == "", F.lit(1)).otherwise(F.try_to_number(found, F.lit("9999999999")).cast("long")).cast("long")


def size_class(n: str | Column, classes: str) -> Column:
    """The class of ``1,2-4,5-9,500-up`` that ``n`` is in, or null."""
    out = F.lit(None).cast("string")
    for part in reversed(classes.split(",")):
        low, _, high = part.strip().partition("-")
        inside = _col(n) >= int(low)
        if high != "up":
            inside &= _col(n) <= int(high or low)
        out = F.when(inside, F.lit(part.strip())).otherwise(out)
    return out
