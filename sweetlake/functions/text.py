"""Column functions: compositions, sequences, labels, masses, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: symbols of a composition in the order of its text.
SYMBOLS = ("HexNAc", "Hex", "dHex", "Fuc", "NeuAc", "NeuGc", "Xyl", "Kdn", "HexA", "P", "S", "Xxx")
#: One-letter codes.
LETTERS = {"HexNAc": "N", "Hex": "H", "Fuc": "F", "dHex": "F", "NeuAc": "S", "NeuGc": "G", "Xyl": "X"}
#: Monoisotopic residue masses of amino acids; water; proton as used for precursors.
AMINO = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891, "I": 113.08406,
    "K": 128.09496, "L": 113.08406, "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858, "R": 156.10111, "S": 87.03203,
    "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER, PROTON = 18.01056, 1.0078
#: Masses of fixed modifications.
MODS = {"Carbamidomethyl": 57.021464, "Oxidation": 15.994915, "Deamidated": 0.984016, "Phospho": 79.966331}


def literal_map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))


def parse_composition(text: Column) -> Column:
    """`HexNAc2Hex5`, `HexNAc(2)Hex(5)` with or without `comp_` as a map; of a repeated symbol the last count holds."""
    body = F.regexp_replace(text, "^comp_", "")
    symbols = F.regexp_extract_all(body, F.lit(r"([A-Za-z+]+)\(?(\d+)\)?"), 1)
    counts = F.transform(F.regexp_extract_all(body, F.lit(r"([A-Za-z+]+)\(?(\d+)\)?"), 2), lambda x: x.cast("int"))
    pairs = F.arrays_zip(symbols.alias("s"), counts.alias("n"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(symbols, i + 2, F.size(symbols)), lambda y: y == x["s"]))
    return F.map_from_entries(last)


def format_composition(counts: Column, style: str = "short", symbols: tuple[str, ...] = SYMBOLS) -> Column:
    """Counts in fixed order: full (all symbols), short (positive ones), bracketed or letter."""
    n = lambda s: F.coalesce(F.try_element_at(counts, F.lit(s)), F.lit(0))
    parts = []
    for s in symbols:
        name = LETTERS.get(s, s) if style == "letter" else s
        text = F.concat(F.lit(name), F.lit("(") if style == "bracketed" else F.lit(""), n(s).cast("string"), F.lit(")") if style == "bracketed" else F.lit(""))
        parts.append(text if style == "full" else F.when(n(s) > 0, text))
    return F.concat_ws("", *parts)


def button_counts(text: Column) -> Column:
    """Counts of a composition text with symbols that carry +aldi folded into Xxx."""
    counts = parse_composition(text)
    aldi = F.aggregate(F.map_values(F.map_filter(counts, lambda k, v: k.contains("+aldi"))), F.lit(0), lambda s, x: s + x)
    plain = F.map_filter(counts, lambda k, v: ~k.contains("+aldi") & (k != "Xxx"))
    xxx = F.coalesce(F.try_element_at(counts, F.lit("Xxx")), F.lit(0)) + aldi
    return F.map_concat(plain, F.map_filter(F.create_map(F.lit("Xxx"), xxx), lambda k, v: v > 0))


def skeletons(sequence: Column) -> Column:
    """Distinct bracketed residue codes of a sequence text, in order."""
    return F.regexp_extract_all(sequence, F.lit(r"\[([^\]]*)\]"), 1)


def sequence_facets(sequence: Column, known: list[str]) -> Column:
    """(skeletons, unknown skeletons, whether a link is bad (carries ?-?), whether it repeats (carries ~n))."""
    codes = skeletons(sequence)
    unknown = F.array_except(codes, F.array(*map(F.lit, known)))
    return F.struct(codes.alias("skeletons"), unknown.alias("unknown"), sequence.contains("?-?").alias("bad_link"), sequence.rlike("~(n|[0-9]+)").alias("repeats"))


def composition_sequence(counts: Column, codes: dict[str, str]) -> Column:
    """Text sequence of a composition: counts, distinct codes in fixed order, then each residue's code number."""
    used = F.filter(F.array(*map(F.lit, codes)), lambda s: F.coalesce(F.try_element_at(counts, s), F.lit(0)) > 0)
    n = lambda s: F.element_at(counts, s)
    listed = F.transform(used, lambda s: F.concat(F.lit("["), F.element_at(literal_map(codes), s), F.lit("]")))
    residues = F.flatten(F.transform(used, lambda s, i: F.array_repeat((i + 1).cast("string"), n(s))))
    return F.concat(F.size(used).cast("string"), F.lit(","), F.size(residues).cast("string"), F.lit("/"), F.array_join(listed, ""), F.lit("/"), F.array_join(residues, "-"))


def fragment_label(label: Column) -> Column:
    """(number of monosaccharides in the brackets, a missing digit is 1; series letter)."""
    inside = F.regexp_extract(label, r"\[([^\]]*)\]", 1)
    digits = F.regexp_extract_all(inside, F.lit("[A-Z]([0-9]*)"), 1)
    number = F.aggregate(digits, F.lit(0), lambda s, d: s + F.when(d == "", 1).otherwise(d.try_cast("int")))
    return F.struct(number.alias("number"), F.lower(F.substring(label, 1, 1)).alias("series"))


def symbol_counts(symbol: Column, letters: str) -> Column:
    """Count of each letter in a compact symbol: its digits, 1 without digits, 0 without the letter."""
    one = lambda c: F.when(~symbol.contains(c), 0).otherwise(F.coalesce(F.regexp_extract(symbol, f"{c}([0-9]+)", 1).try_cast("int"), F.lit(1)))
    return F.struct(*(one(c).alias(c) for c in letters))


def peptide_mass(sequence: Column) -> Column:
    """Residue masses and water; null for an unknown letter."""
    table = literal_map(AMINO)
    return F.aggregate(F.filter(F.split(sequence, ""), lambda c: c != ""), F.lit(WATER), lambda s, c: s + F.try_element_at(table, c))


def mod_mass(name: Column) -> Column:
    return F.try_element_at(literal_map(MODS), name)


def peptide_key(sequence: Column, glycans: Column, mods: Column) -> Column:
    """Canonical key: sequence, then sorted glycans (acc, site), then sorted modifications (delta, site)."""
    g = F.transform(F.array_sort(glycans), lambda x: F.concat_ws("@", x["acc"], x["site"]))
    m = F.transform(F.array_sort(mods), lambda x: F.concat_ws("@", F.format_number(x["delta"], 3), x["site"]))
    return F.concat_ws("|", sequence, F.array_join(g, ","), F.array_join(m, ","))


def peptide_name(sequence: Column, marks: Column) -> Column:
    """The sequence with each mark (site from 1, text) in brackets behind its residue."""
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    of = lambda i: F.array_join(F.transform(F.filter(marks, lambda m: m["site"] == i + 1), lambda m: F.concat(F.lit("["), m["text"], F.lit("]"))), "")
    return F.array_join(F.transform(letters, lambda c, i: F.concat(c, of(i))), "")


def precursor_mass(mz: Column, z: Column) -> Column:
    return mz * z - PROTON * z


def sequence_hash(text: Column, kind: str = "sha256") -> Column:
    """Lower-case hex digest."""
    return {"sha256": F.sha2(text, 256), "md5": F.md5(text), "sha1": F.sha1(text)}[kind]


#: Text repairs, in order.
REPAIRS = (("α", "a"), ("β", "b"), ("→", "-"), ("↔", "-"), ("–", "-"), ("(-", "("), ("-)", ")"), ("--", "-"), (" ,", ","), ("  ", " "))


def clean_iupac(text: Column) -> Column:
    for old, new in REPAIRS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_name(text: Column) -> Column:
    """White space collapsed and trimmed, lower case."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def retention_nrt(rt_seconds: Column, slope: Column, intercept: Column) -> Column:
    """Normalised retention time of seconds by a linear calibration in minutes."""
    return rt_seconds / 60 * slope + intercept


def retention_rt(nrt: Column, slope: Column, intercept: Column) -> Column:
    """Seconds of a normalised retention time."""
    return (nrt - intercept) / slope * 60


def two_point(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The line through two points; null where they share x."""
    return F.when(x1 != x2, y1 + (x - x1) * (y2 - y1) / (x2 - x1))


def chance_any(p: Column, k: Column) -> Column:
    """1 - (1 - p)^k, 1 where p is at least 1."""
    return F.when(p >= 1, F.lit(1.0)).otherwise(1 - F.pow(1 - p, k))
