"""Names of authors, read only where their form leaves no doubt; and agents as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An agent: kind is person, org or str; literal is the text of a str.
AGENT = "struct<kind string, first_name string, middle_name string, surname string, role_name string, name string, literal string>"

#: What shows that a text is not a plain list of names, markers that stand for authors, particles that begin surnames.
NOT_NAMES = [" and ", " - ", "ed.", "Ed.", "(", "et al"]
MARKERS = ["AA. VV", "AA. VV.", "Ead.", "Ibid.", "AA.VV", "AA.VV."]
PARTICLES = "da di del della dell' degli van von de le la".split()

_WORD = "[A-Z][a-z]+"
_SURNAME = rf"{_WORD}(?:\s+{_WORD})?"
_PARTICLE_SURNAME = rf"{_WORD}(?:\s+{_WORD})+"
_INITIALS = r"[A-Z]\.(?:\s+[A-Z]\.)*"
_GIVEN = r"[A-Z](?:[a-z]+|\.(?:\s+[A-Z]\.)*)"
#: A capital and then small letters only, or parts such as 'Brien after O.
_PROPER = r"\p{Lu}(?:[^\p{Lu}\s]*\p{Ll}[^\p{Lu}\s]*|(?:[^\p{L}\s]+\p{Lu}\p{Ll}*)+)?"


def agent(kind: str, **fields: Column) -> Column:
    """An agent of the kind with the fields given; empty ones are null."""
    names = ("first_name", "middle_name", "surname", "role_name", "name", "literal")
    value = lambda n: F.nullif(fields[n], F.lit("")) if n in fields else F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), *(value(n).alias(n) for n in names))


def agent_string(a: Column) -> Column:
    """'First Middle Surname', the role of a person without names; an organisation's name; a text as it is."""
    names = F.concat_ws(" ", *(F.nullif(a[n], F.lit("")) for n in ("first_name", "middle_name", "surname")))
    person = F.when(names != "", names).otherwise(F.coalesce(a["role_name"], F.lit("")))
    return F.when(a["kind"] == "person", person).when(a["kind"] == "org", F.coalesce(a["name"], F.lit(""))).otherwise(F.coalesce(a["literal"], F.lit("")))


def _initialed(surname: Column, initials: Column, more: Column | None = None) -> Column:
    """A person of 'I. J.': the first initial, and the others, with what follows them, as middle name."""
    parts = F.split(F.trim(initials), r"\s+")
    middle = F.array_join(F.slice(parts, 2, 99), " ")
    return agent("person", first_name=F.get(parts, F.lit(0)), middle_name=middle if more is None else F.trim(F.concat_ws(" ", middle, more)), surname=surname)


def initialed_authors(c: Column) -> Column:
    """Persons of 'Surname, I. J., Surname, I., ...' as far as the text goes on like that; null for fewer than two."""
    one = rf"({_SURNAME}),\s+({_INITIALS})"
    start = F.regexp_extract(F.trim(c), rf"^(?:{one}[\s,]*)+", 0)
    found = F.regexp_extract_all(start, F.lit(one), F.lit(0))
    return F.when(F.size(found) >= 2, F.transform(found, lambda x: _initialed(F.regexp_extract(x, one, 1), F.regexp_extract(x, one, 2))))


def parsed_authors(c: Column) -> Column:
    """Agents of an author field. In this order: texts that are no plain names stay texts; several names with initials;
    'Surname I., I. Surname'; two or three capitalised words; 'Surname I. J.'; 'I. J. Surname'; 'Surname, First' with initials after
    it; else the text as it stands. ' e ' and ' et ' separate several names like commas. A null or empty field gives one agent
    without a text."""
    text = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), ",+$", "")
    unread = F.array(agent("str", literal=c))
    skip = text.isin(MARKERS) | ((F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 5) & ~text.rlike(r"^[A-Z]\.\s+[A-Z]+$"))
    for mark in NOT_NAMES:
        skip = skip | F.contains(text, F.lit(mark))

    several = F.regexp_replace(text, r"\s+(?:e|et)\s+", ", ")
    many = rf"^(?:{_SURNAME},\s+{_INITIALS},?\s*){{2,}}$"
    two = rf"^({_SURNAME})\s+([A-Z]\.),\s+([A-Z]\.)\s+({_SURNAME}),?\s*$"
    part = lambda k: F.regexp_extract(several, two, k)
    both = F.array(agent("person", first_name=part(2), surname=part(1)), agent("person", first_name=part(3), surname=part(4)))

    plain = rf"^{_PROPER}(?:\s+{_PROPER}){{1,2}}$"
    words = F.split(text, r"\s+")
    named = F.array(agent("person", first_name=F.get(words, F.lit(0)), middle_name=F.when(F.size(words) == 3, F.get(words, F.lit(1))), surname=F.element_at(words, -1)))

    has_particle = text.rlike(r"(?i)^(?:" + "|".join(PARTICLES) + r")\s+")

    def by_surname(after: str, make) -> tuple[Column, Column]:
        """(whether the text is a surname and what follows it, the agents), by whether a particle begins it."""
        forms = [rf"^({s}){after}" for s in (_PARTICLE_SURNAME, _SURNAME)]
        fits = F.when(has_particle, text.rlike(forms[0])).otherwise(text.rlike(forms[1]))
        return fits, F.when(has_particle, make(forms[0])).otherwise(make(forms[1]))

    get = lambda pattern, k: F.regexp_extract(text, pattern, k)
    trailing, trailing_agents = by_surname(rf"\s+({_INITIALS})$", lambda p: F.array(_initialed(get(p, 1), get(p, 2))))
    leading = rf"^({_INITIALS})\s+({_SURNAME}|[A-Z]+)$"

    def inverted(pattern: str) -> Column:
        given, rest = get(pattern, 2), F.trim(F.regexp_replace(text, pattern, ""))
        rest = F.nullif(rest, F.lit(""))
        initialed = _initialed(get(pattern, 1), F.replace(given, F.lit("."), F.lit(". ")), rest)
        full = agent("person", first_name=given, middle_name=rest, surname=get(pattern, 1))
        return F.when(rest.isNotNull() & ~F.contains(rest, F.lit(".")), unread).otherwise(F.array(F.when(F.contains(given, F.lit(".")), initialed).otherwise(full)))

    comma, comma_agents = by_surname(rf",\s+({_GIVEN})", inverted)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", unread).when(skip, unread)
        .when(several.rlike(many), F.coalesce(initialed_authors(several), unread)).when(several.rlike(two), both)
        .when(~F.contains(text, F.lit(",")) & ~F.contains(text, F.lit(".")) & text.rlike(plain), named)
        .when(trailing, trailing_agents).when(text.rlike(leading), F.array(_initialed(get(leading, 2), get(leading, 1))))
        .when(comma, comma_agents).otherwise(unread)
    )
