"""Column functions on text: tokens, accents, words, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English function words.
ENGLISH = """
the of and to in for you your with is are this that it we our on at as be from by or an will can
have has not was were been being do does did doing but if then than so such no nor only own same
too very just about into over under again further once here there when where why how all any both
each few more most other some what which who whom these those they them their there's i'm it's
"""
# French function words, without accents; the forms of avoir and etre follow by rule.
FRENCH = """
au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me meme mes
moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un
une vos votre vous c d j l a m n s t y suis es est sommes sont as ont soient ceci cela celui celle
ceux celles donc dont ici quel quelle quels quelles sans si sous entre vers chez tout tous toute
toutes autre autres memes aussi tres plus moins bien fait faire peut peuvent doit doivent etre
avoir cette cet leurs lorsque apres avant depuis pendant contre selon afin ainsi alors car comme
quand encore deja toujours jamais chaque tel telle non oui
"""
# Words of buttons and menus.
INTERFACE = """
read more view click here learn discover home menu back share print newsletter cookies next
previous page pages download contact subscribe search login signup lire suite voir cliquez
cliquer savoir accueil retour partager imprimer telecharger decouvrir contactez precedente
"""
_PAST, _FUTURE = "ais ait ions iez aient", "ai as a ons ez ont"
#: Stem -> endings of avoir and etre.
FORMS = {
    "ser": f"{_FUTURE} {_PAST}", "aur": f"{_FUTURE} {_PAST}", "et": f"{_PAST} e ee ees es ant", "av": f"{_PAST} ons ez",
    "fu": "s t mes tes rent sse sses ssions ssiez ssent", "eu": "e es s mes tes rent sse sses", "soi": "s t", "soy": "ons ez", "ai": "e es t ent", "ay": "ons ez ant",
}
STOP = frozenset(f"{ENGLISH} {FRENCH} {INTERFACE} eu ai".split()) | {s + e for s, es in FORMS.items() for e in es.split()}

#: Letters of the token alphabet that carry an accent, and what is left of them.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def strip_accents(c: Column) -> Column:
    """Latin-1 letters in lower case without their accents (æ, ð, ø and þ have none)."""
    return F.translate(c, ACCENTED, PLAIN)


def tokens(text: Column, stop: frozenset[str] = STOP) -> Column:
    """The tokens of a text in order: runs of Latin-1 letters and digits, lower-cased, of three or more
    characters, neither all digits nor stop words (compared without accents). Null gives null, no token an empty array."""
    runs = F.split(F.lower(F.translate(text, "’'", "  ")), "(?iu)[^a-zà-öø-ÿ0-9]+")
    return F.filter(runs, lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~strip_accents(w).isin(*sorted(stop)))


def bigrams(t: Column) -> Column:
    """Neighbouring tokens joined by a blank; stop words that stood between them are gone already."""
    return F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c: Column) -> Column:
    """Number of runs without white space; 0 for null, empty and blank text."""
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def sentences(c: Column) -> Column:
    """Parts between white space that follows a full stop, an exclamation or a question mark; blank parts dropped."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def anchor_key(c: Column) -> Column:
    """An anchor as it is compared: lower case, blanks and ``.:!?"'`` off both ends."""
    return F.regexp_replace(F.lower(c), "^[ .:!?\"']+|[ .:!?\"']+$", "")
