"""Counts of certificates, candidates and links, each in one pass, and how they are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import names


def _valid(r: str):
    return names.is_valid(F.col(f"{r}.given"), F.col(f"{r}.family"), F.col("event"))


def index_summary(certificates: DataFrame) -> DataFrame:
    """One row: total, indexed (a valid subject with a valid parent), and by which parents are valid."""
    s, m, f = _valid("subject"), _valid("subject_mother"), _valid("subject_father")
    counts = {"indexed": s & (m | f), "both_parents": s & m & f, "mother_only": s & m & ~f, "father_only": s & f & ~m}
    return certificates.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def index_summary_single(certificates: DataFrame) -> DataFrame:
    """One row: total and indexed, where only subjects are sought."""
    return certificates.agg(F.count("*").alias("total"), F.count_if(_valid("subject")).alias("indexed"))


def index_summary_couples(certificates: DataFrame) -> DataFrame:
    """One row: total and indexed, where couples are sought: both valid, one of them a woman."""
    s, p = (names.gender(F.col(f"{r}.gender")) == "FEMALE" for r in ("subject", "partner"))
    return certificates.agg(F.count("*").alias("total"), F.count_if(_valid("subject") & _valid("partner") & (s | p)).alias("indexed"))


def index_summary_marriages(certificates: DataFrame) -> DataFrame:
    """One row for the index of brides, grooms and their parents: the bride's side, and for those with a valid groom his side."""
    s, m, f, p, pm, pf = map(_valid, ("subject", "subject_mother", "subject_father", "partner", "partner_mother", "partner_father"))
    indexed = s & (p | m | f)
    counts = {
        "indexed": indexed, "mother_only": indexed & m & ~f, "father_only": indexed & f & ~m, "both_parents": indexed & m & f, "partner": indexed & p,
        "partner_mother_only": indexed & p & pm & ~pf, "partner_father_only": indexed & p & pf & ~pm, "partner_both_parents": indexed & p & pm & pf,
    }
    return certificates.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def link_summary(links: DataFrame) -> DataFrame:
    """Number of links by those of link, family_line and kind that the table has."""
    by = [c for c in ("link", "family_line", "kind") if c in links.columns]
    return links.groupBy(*by).agg(F.count("*").alias("n_links"))


def candidate_summary(discovered: DataFrame, passed: DataFrame) -> DataFrame:
    """One row: candidates found (links without regard to dates), those that passed, those that failed, and links found more than once.

    Both are links of one process; a pair of certificates counts by its kind and family line.
    """
    keys = [c for c in ("a_event", "b_event", "link", "family_line", "kind") if c in discovered.columns and c in passed.columns]
    both = discovered.select(*keys, F.lit(1).alias("d"), F.lit(0).alias("p")).unionByName(passed.select(*keys, F.lit(0).alias("d"), F.lit(1).alias("p")))
    pairs = both.groupBy(*keys).agg(F.sum("d").alias("d"), F.sum("p").alias("p"))
    return pairs.agg(
        F.count_if(F.col("d") > 0).alias("discovered"), F.count_if(F.col("p") > 0).alias("passed"), F.count_if((F.col("d") > 0) & (F.col("p") == 0)).alias("failed"), F.coalesce(F.sum(F.greatest(F.col("p") - 1, F.lit(0))), F.lit(0)).alias("duplicates")
    )


def match_strength(links: DataFrame) -> DataFrame:
    """Links between marriages by link and strength: strong with both parents of a spouse, weak with one."""
    strength = F.when(F.col("kind") == "both", "strong").otherwise("weak")
    return links.groupBy("link", strength.alias("strength")).agg(F.count("*").alias("n_links"))


def shown(counts: DataFrame) -> DataFrame:
    """A row of counts as (name, value) with thousands set apart."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.format_number(F.col(c), 0).alias("value")) for c in counts.columns))
    return counts.select(F.explode(pairs).alias("x")).select("x.*")
