"""Class labels, ids and small rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of a secondary-structure class, each list under the class that it stands for.
SECONDARY = {
    "alpha": ("alpha", "all_alpha", "mainly_alpha", "helix"),
    "beta": ("beta", "all_beta", "mainly_beta", "sheet", "strand"),
    "alpha_beta": ("alpha_beta", "mixed_alpha_beta", "alpha/beta", "alpha+beta", "mixed"),
    "coil_or_sparse": ("coil", "few_secondary_structures", "little_secondary_structure"),
}


def folded(value: Column) -> Column:
    """Trimmed, lower case, `-` and space as `_`; null reads empty."""
    return F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")


def class_of(value: Column, names: dict[str, tuple[str, ...]] = SECONDARY) -> Column:
    """The class that a name stands for; another name is kept as folded, an empty one is unknown."""
    text = folded(value)
    out = F.when(text == "", "unknown")
    for name, known in names.items():
        out = out.when(text.isin(*known), name)
    return out.otherwise(text)


def class_of_shares(helix: Column, beta: Column, coil: Column) -> Column:
    """Class by shares, first rule first; unknown where helix or beta is missing. A null coil share and NaN meet no rule."""
    high = lambda c, x: F.coalesce((c >= x) & ~F.isnan(c), F.lit(False))
    low = lambda c, x: F.coalesce((c < x) & ~F.isnan(c), F.lit(False))
    rule = F.when(helix.isNull() | beta.isNull(), "unknown").when(high(helix, 0.4) & low(beta, 0.2), "alpha").when(high(beta, 0.3) & low(helix, 0.2), "beta")
    return rule.when(high(helix, 0.2) & high(beta, 0.15), "alpha_beta").when(high(coil, 0.7), "coil_or_sparse").otherwise("mixed_low_confidence")


#: Names of an architecture, each list under the class that it stands for, after `+` and `/` became `_` too.
ARCHITECTURE = {
    "alpha": ("alpha", "all_alpha", "mainly_alpha", "alpha_bundle", "alpha_bundles", "alpha_array"),
    "beta": ("beta", "all_beta", "mainly_beta", "beta_sheet", "beta_sandwich", "beta_sandwiches", "beta_barrel"),
    "alpha_beta": ("alpha_beta", "a_b", "a_b_two_layers", "a_b_three_layers", "a_b_four_layers", "mixed"),
    "coil_or_sparse": ("coil", "few_secondary_structures", "little_secondary_structure", "small_protein"),
}
#: Shares of helix, beta and coil that stand in where only the class is known.
SHARES = {"alpha": (0.7, 0.05, 0.25), "beta": (0.05, 0.55, 0.4), "alpha_beta": (0.35, 0.25, 0.4), "coil_or_sparse": (0.05, 0.05, 0.9), "mixed_low_confidence": (0.25, 0.15, 0.6)}


def architecture_of(value: Column) -> Column:
    """Class of an architecture by its name, else by the words in it, first rule first; another name is kept as folded, an empty one is unknown."""
    text = F.translate(folded(value), "+/", "__")
    has = lambda *words: text.rlike("|".join(words))
    out = F.when(text == "", "unknown")
    for name, known in ARCHITECTURE.items():
        out = out.when(text.isin(*known), name)
    out = out.when((has("alpha") & has("beta")) | has("a_b"), "alpha_beta")
    return out.when(has("alpha", "helical", "helix"), "alpha").when(has("beta", "sandwich", "barrel"), "beta").otherwise(text)


def shares_of_class(value: Column) -> Column:
    """Struct of class, helix, beta and coil that stand in for an architecture; any other than the four is mixed_low_confidence."""
    name = architecture_of(value)
    rows = [(c, F.struct(F.lit(c).alias("class"), *(F.lit(x).alias(n) for n, x in zip(("helix", "beta", "coil"), shares)))) for c, shares in SHARES.items()]
    out = F.when(name == rows[0][0], rows[0][1])
    for c, row in rows[1:-1]:
        out = out.when(name == c, row)
    return out.otherwise(rows[-1][1])


def first_present(fields: Column, *names: str) -> Column:
    """The value of the first name that a map has, even if that value is null; null if it has none."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(fields, name), F.try_element_at(fields, F.lit(name))).otherwise(out)
    return out


def share(value: Column) -> Column:
    """A number written as text, null if it is none or below 0; `nan` is a number."""
    number = F.trim(value).try_cast("double")
    return F.when((number >= 0) | F.isnan(number), number)


def payload_class(fields: Column) -> Column:
    """Struct of class, helix, beta, coil, architecture, source and n_sources of a map of texts whose keys have two names.

    A key that is there decides, even with a null value. Without a class the shares decide; a missing architecture and source are unknown, a
    missing, negative or fractional number of sources is 0.
    """
    helix, beta, coil = (share(first_present(fields, f"secondary_{n}_fraction", f"{n}_fraction")) for n in ("helix", "beta", "coil"))
    named = first_present(fields, "secondary_structure_class", "structural_class")
    filled = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    n = F.greatest(F.coalesce(first_present(fields, "metadata_source_count").try_cast("int"), F.lit(0)), F.lit(0))
    return F.struct(
        class_of(F.coalesce(named, class_of_shares(helix, beta, coil))).alias("class"), helix.alias("helix"), beta.alias("beta"), coil.alias("coil"),
        filled(F.lower(first_present(fields, "domain_architecture_class"))).alias("architecture"), filled(first_present(fields, "domain_architecture_source")).alias("source"), n.alias("n_sources"),
    )


def chain_of_domain(domain: Column) -> Column:
    """`entry_chain` of a domain id: a leading e goes, four characters are the entry (in lower case), a last digit goes; null if too short."""
    text = F.trim(domain)
    body = F.when(F.lower(F.substring(text, 1, 1)) == "e", F.substring(text, 2, 1 << 30)).otherwise(text)
    chain = F.regexp_replace(F.substring(body, 5, 1 << 30), "[0-9]$", "")
    return F.when((F.length(text) >= 6) & (chain != ""), F.concat_ws("_", F.lower(F.substring(body, 1, 4)), chain))


def listed(text: Column) -> Column:
    """Items of a comma list, trimmed, without blank and repeated ones, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def salt_digest(salt: str, least: int = 32) -> str:
    """What is published of a salt, which has to have `least` characters."""
    import hashlib

    if len(salt.strip()) < least:
        raise ValueError(f"a salt of {least} characters or more is needed")
    return hashlib.sha256(salt.strip().encode()).hexdigest()


def budgets(batch: Column, accumulated: Column, steps: Column, crop: Column) -> Column:
    """Struct of effective batch, samples and residues that a run may see."""
    effective = (batch * accumulated).cast("long")
    return F.struct(effective.alias("batch"), (effective * steps).alias("samples"), (effective * steps * crop).alias("residues"))


def mismatches(expected: dict[str, Column], actual: dict[str, Column]) -> Column:
    """Names, in order, of which the two differ; nulls equal each other, a missing name reads null."""
    named = (F.when(~value.eqNullSafe(actual.get(name, F.lit(None))), F.lit(name)) for name, value in expected.items())
    return F.array_compact(F.array(*named))


def fails_gate(stats: dict[str, Column], least: dict[str, float]) -> Column:
    """Whether any statistic lies below its least value; a missing one (null or NaN) reads 0."""
    out = F.lit(False)
    for name, limit in least.items():
        out = out | (F.coalesce(F.nanvl(stats[name].cast("double"), F.lit(0.0)), F.lit(0.0)) < limit)
    return out


#: Codes and names of the top level of a class list.
TOP_LEVEL = {
    "alpha": ("1", "mainly alpha", "mainly_alpha"),
    "beta": ("2", "mainly beta", "mainly_beta"),
    "alpha_beta": ("3", "alpha beta", "alpha_beta"),
    "coil_or_sparse": ("4", "few secondary structures", "few_secondary_structures"),
}
#: First letters of a concise class string.
FIRST_LETTER = {"alpha": "a", "beta": "b", "alpha_beta": "cd", "coil_or_sparse": "gh"}


def class_of_code(value: Column) -> Column:
    """Class by top-level code or name, else by the rules of architectures."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, known in TOP_LEVEL.items():
        out = F.when(text.isin(*known), name).otherwise(out)
    return F.coalesce(out, architecture_of(text))


def class_of_sccs(value: Column) -> Column:
    """Class by the first letter of a concise class string; another letter is `other`, an empty string unknown."""
    letter = F.substring(F.lower(F.trim(F.coalesce(value, F.lit("")))), 1, 1)
    out = F.when(letter == "", "unknown")
    for name, known in FIRST_LETTER.items():
        out = out.when(letter.isin(*known), name)
    return out.otherwise("other")


def class_of_words(line: Column) -> Column:
    """Class by the words that a line holds, first rule first."""
    has = lambda *words: F.lower(line).rlike("|".join(words))
    both = (has("alpha") & has("beta")) | has(r"a\+b", "a/b")
    return F.when(both, "alpha_beta").when(has("alpha", "helical", "helix"), "alpha").when(has("beta", "sandwich", "barrel"), "beta").otherwise("unknown")
