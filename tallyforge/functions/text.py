"""Checks of reports against the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with its sign, where no word, point or hyphen goes before.
_NUMBER = r"(?:^|[^\w.-])(-?\d+(?:\.\d+)?)"


def numbers(text: Column) -> Column:
    """Numbers in a text that stand alone, with their signs, once each; a percent sign is left out."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NUMBER), 1))


def renderings(values: Column) -> Column:
    """How a report may show numbers of its evidence: one or two decimals, and those below 1 also as a percentage, with or without sign."""
    def shown(x: Column) -> Column:
        share = 100 * x
        plain = F.array(F.format_string("%.1f", x), F.format_string("%.2f", x))
        percent = F.array(*[F.format_string(f, y) for y in (share, F.abs(share)) for f in ("%.1f", "%.2f")])
        return F.when((F.abs(x) < 1) & (x != 0), F.concat(plain, percent)).otherwise(plain)

    return F.array_distinct(F.flatten(F.transform(F.filter(values, lambda v: v.isNotNull()), shown)))


def unsupported(text: Column, packet: Column, values: Column) -> Column:
    """Numbers of a text that neither stand in its packet (JSON) nor are a rendering of one of its values."""
    return F.array_sort(F.array_except(numbers(text), F.concat(numbers(packet), renderings(values))))


#: The form of a citation.
def cites_evidence(text: Column) -> Column:
    return text.rlike(r"\[E\d+\]")


def missing_sections(text: Column, headings: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(h) for h in headings]), lambda h: ~F.contains(text, h))


def has_sections(text: Column, headings: list[str]) -> Column:
    return F.size(missing_sections(text, headings)) == 0


def report_checks(text: Column, packet: Column, values: Column, headings: list[str]) -> dict[str, Column]:
    """The four checks of a report: sections, citations, numbers, text; and the numbers without support."""
    bad = unsupported(text, packet, values)
    return {"sections_ok": has_sections(text, headings), "citations_ok": cites_evidence(text), "numbers_ok": F.size(bad) == 0, "not_empty": F.trim(text) != "", "unsupported": F.array_join(bad, ",")}
