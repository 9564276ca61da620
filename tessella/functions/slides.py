"""Slide names: type, stain and sample rules as native expressions, in named profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers in the order in which they are tried.
MARKERS = ["CD3", "GFAP", "IBA1", "NF", "PGP", "PGP9-5"]
#: Stains and the patterns that their slide names start with.
STAIN_PATTERNS = {
    "H&E": r"^(HE|H&E|HandE)", "CD3": r"^CD3-", "GFAP": r"^GFAP-", "Iba1": r"^(Iba1|Ibal)-",
    "NF": r"^NF-", "PGP9.5": r"^PGP9[._-]?5-", "PID": r"^(PID|BID)",
}


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(svs|tif|tiff|ndpi|png|csv)$", "")


def slide_type(name: Column, profile: str = "detector") -> Column:
    """``H&E`` or ``IHC_<marker>``; the profiles differ for PID, HCC and PGP names."""
    up = F.upper(name)
    if profile == "shell":
        rules = [(r"^PGP|^PID30", "IHC_PGP95"), (r"^HCC|^HE", "H&E"), *((f"^{m}", f"IHC_{m}") for m in ("CD3", "GFAP", "IBA1", "NF"))]
    else:
        rules = [(r"\bHE[-=_]", "H&E"), *((rf"\b{m}[-_]", "IHC_" + m.replace("-", "")) for m in MARKERS), (r"PID|BIDS\d+", "H&E")]
    out = F.lit("H&E")
    for pattern, kind in reversed(rules):
        out = F.when(up.rlike(pattern), kind).otherwise(out)
    return out


def stain_slide(name: Column, stain: str) -> Column:
    """Whether a slide is of a stain, whatever the case of either; never of a stain without a pattern."""
    patterns = {k.lower(): v for k, v in STAIN_PATTERNS.items()}
    pattern = patterns.get(stain.lower().replace("9-5", "9.5").replace("9_5", "9.5"))
    return F.when(name.isNotNull(), F.lit(False)) if pattern is None else name.rlike("(?i)" + pattern)


def normalized(name: Column, profile: str = "combined") -> Column:
    """Mends the misspelt BIDS family: ``separate`` runs give PID, whatever the case; ``combined`` ones PID-S."""
    return F.regexp_replace(name, r"(?i)^BIDS", "PID") if profile == "separate" else F.regexp_replace(name, r"^BIDS", "PID-S")


def parse_name(name: Column) -> tuple[Column, Column]:
    """(stain, sample) of a slide name, the stain in its usual spelling; both null where no rule fits."""
    n = normalized(name)
    parts = F.split(n, "-", -1)
    pid = F.regexp_extract(n, r"(?i)^PID\d+([BS]\d+)", 1)
    three = n.rlike(r"^PGP9-5-[^-]*$")
    part = lambda k: F.get(parts, F.lit(k))
    head = F.upper(part(0))
    usual = F.when(head.isin("HE", "H&E", "HE="), "H&E").when(head.contains("PGP"), "PGP9.5").when(head == "IBA1", "Iba1").when(head.isin("CD3", "GFAP", "NF", "PID"), head)
    some = F.size(parts) >= 2
    stain = F.when(pid != "", "PID").when(three, "PGP9.5").when(some, F.coalesce(usual, part(0)))
    sample = F.when(pid != "", F.upper(pid)).when(three, F.upper(part(2))).when(some, F.upper(part(1)))
    return stain, sample


def is_ihc(kind: Column) -> Column:
    return kind.startswith("IHC_")


def marker(kind: Column) -> Column:
    return F.when(is_ihc(kind), F.get(F.split(kind, "_"), F.lit(1)))


def complete_samples(slides: DataFrame, least: int = 5) -> DataFrame:
    """Samples (sample, stains) that have H&E and at least ``least`` stains."""
    grouped = slides.where("sample is not null").groupBy("sample").agg(F.sort_array(F.collect_set("stain")).alias("stains"))
    return grouped.where(F.array_contains("stains", "H&E") & (F.size("stains") >= least))


def stain_paths(slides: DataFrame) -> DataFrame:
    """One row per sample with a map from stain to path; of several paths the last by name is taken."""
    one = slides.where("sample is not null").groupBy("sample", "stain").agg(F.max("path").alias("path"))
    return one.groupBy("sample").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stain", "path")))).alias("paths"))


def marker_info(name: Column, info: dict[str, str], default: str = "Unknown marker") -> Column:
    """A marker's description by name, from a plan-time table; case and dashes don't count."""
    key = F.replace(F.upper(name), F.lit("-"), F.lit(""))
    out = F.lit(default)
    for k, v in reversed(info.items()):
        out = F.when(key == k.upper().replace("-", ""), v).otherwise(out)
    return out
