"""Names, slugs and match keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accented letters and the plain letters that replace them in slugs.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěìíîïīįłńñňòóôõöøōőřśšşťţùúûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorsssttuuuuuuuyyzzz"


def slug(name: Column) -> Column:
    """Lower-case words joined by dashes; accents are folded by a letter table."""
    plain = F.translate(F.lower(F.trim(name)), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def surname(name: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(name), " +"), -1))


def by_surname(one: Column, two: Column) -> tuple[Column, Column]:
    """The two names ordered by surname, then by full name."""
    swap = (surname(one) > surname(two)) | ((surname(one) == surname(two)) & (one > two))
    return F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)


def match_key(one: Column, two: Column, day: Column) -> Column:
    """The same text from either side of a match."""
    return F.concat_ws("_", F.least(one, two), F.greatest(one, two), day.cast("string"))
