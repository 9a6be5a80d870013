"""Tokens, stop words and text assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
ENGLISH = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for
with about against between into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can
will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
weren't won won't wouldn wouldn't""".split()
# Danish stop words.
DANISH = """og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da
fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned
skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle hos blive mange ad
bliver hendes været thi jer sådan""".split()

STOP = {"en": ENGLISH, "da": DANISH}
#: ASCII for English; letters, digits and underscore of any script for Danish.
TOKEN = {"en": "[a-z0-9]+", "da": r"(?U)\w+"}


def language(dataset: Column) -> Column:
    """English for datasets named mind..., else Danish."""
    return F.when(F.startswith(F.lower(dataset), F.lit("mind")), "en").otherwise("da")


def tokens(text: Column, lang: str = "en", stopwords: bool = False) -> Column:
    """Lower-cased tokens in order; stopwords: leave those out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN[lang]), F.lit(0))
    stop = F.array(*map(F.lit, STOP[lang]))
    return F.filter(found, lambda t: ~F.array_contains(stop, t)) if stopwords else found


def cleaned(title: Column, abstract: Column) -> Column:
    """Title, a space and the abstract; the title alone without one."""
    return F.concat_ws(" ", title, abstract)
