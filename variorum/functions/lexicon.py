"""Word lists and spelling rules. Lists are values that results depend on; tables come from rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that seldom change what a passage says
FUNCTION_WORDS = (
    "the", "a", "an", "and", "or", "but", "nor", "for", "yet", "so",
    "in", "on", "at", "to", "of", "by", "with", "from", "into", "upon",
    "is", "was", "are", "were", "be", "been", "being", "am",
    "have", "has", "had", "do", "does", "did",
    "will", "would", "shall", "should", "may", "might", "must", "can", "could",
    "he", "she", "it", "they", "we", "you", "i",
    "his", "her", "its", "their", "our", "your", "my",
    "him", "them", "us",
    "this", "that", "these", "those",
    "which", "who", "whom", "whose", "what",
    "not", "no", "all", "each", "every", "some", "any", "both",
    "very", "quite", "rather", "somewhat", "too", "also",
    "here", "there", "now", "then", "when", "where",
    "if", "than", "as", "while", "after", "before", "since", "until",
)

# fixed values: negations
NEGATIONS = (
    "not", "no", "never", "neither", "nor", "nothing", "none", "nowhere",
    "n't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't",
    "couldn't", "shouldn't", "isn't", "aren't", "wasn't",
    "weren't", "hasn't", "haven't", "hadn't",
)

# fixed values: words too common to make a phrase distinctive
COMMON_WORDS = (
    "the", "a", "an", "and", "of", "to", "in", "is", "was", "it", "that",
    "he", "she", "his", "her", "they", "their", "them", "but", "for", "with",
    "not", "all", "were", "had", "has", "been", "from", "this", "which",
    "or", "as", "at", "be", "by", "on", "do", "if", "so", "no", "we",
    "would", "could", "should", "may", "one", "into", "more", "than",
    "its", "him", "my", "me", "your", "what", "when", "there", "each",
    "very", "much", "any", "some", "up", "out", "about", "how", "other",
)

# fixed values: words of which alone no content hole is made
HOLE_STOPS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at",
    "to", "of", "for", "with", "is", "was", "are", "were",
    "be", "been", "have", "has", "had", "it", "its", "he",
    "she", "they", "we", "i", "you", "this", "that", "as",
)

# British spellings and what they are in American ones, applied in this order to a whole
# word in lower case; the patterns are rules of spelling, valid in Java's, RE2's and Python's syntax
BRITISH = (
    (r"^([a-z]{2,})our(s|ed|ing|ings|er|ers|able|ably|ite|ites|al|ful|less|hood|hoods|y|ly)?$", r"\1or\2"),
    (r"^([a-z]*)oeuvring$", r"\1euvering"),
    (r"^([a-z]*)oeuvr([a-z]*)$", r"\1euvr\2"),
    (r"^([a-z]+)([bghtv])re$", r"\1\2er"),
    (r"^([a-z]+)([bghtv])red$", r"\1\2ered"),
    (r"^([a-z]+)([bghtv])re(s|ly)$", r"\1\2er\3"),
    (r"^([a-z]{3,}|ag)is(e|es|ed|ing|er|ers|able|ant|ation|ations|ement|ements)$", r"\1iz\2"),
    (r"^([a-z]+)lys(e|es|ed|ing|er|ers)$", r"\1lyz\2"),
    (r"^(def|off|pret|lic)enc(e|es|ing)$", r"\1ens\2"),
    (r"^([a-z]{2,})ogu(ed|ing)$", r"\1og\2"),
    (r"^([a-z]{2,})ogue(s)?$", r"\1og\2"),
    (r"^([a-z]*[aeiou][a-z]*[^aeiou][aeiou]|fue|due)ll(ed|ing|ings|er|ers|or|ors)$", r"\1l\2"),
    (r"^([a-z]+)xion(s)?$", r"\1ction\2"),
    (r"^([a-z]+)dgement(s)?$", r"\1dgment\2"),
    (r"^([a-z]*)ae([a-z]+)$", r"\1e\2"),
    (r"^(|f|gonorrh|am|diarrh|hom|prot|phil)oe([a-z]+)$", r"\1e\2"),
    (r"^(m|sm)ould([a-z]*)$", r"\1old\2"),
    (r"^plough([a-z]*)$", r"plow\1"),
    (r"^grey([a-z]*)$", r"gray\1"),
    (r"^sceptic([a-z]*)$", r"skeptic\1"),
    (r"^despatch([a-z]*)$", r"dispatch\1"),
)

# fixed values: (American, British) words that no rule above has
SPELLINGS = (
    ("practise", "practice"), ("aging", "ageing"), ("aluminum", "aluminium"), ("appall", "appal"), ("artifact", "artefact"), ("artifacts", "artefacts"),
    ("ax", "axe"), ("balk", "baulk"), ("carburetor", "carburettor"), ("carburetors", "carburettors"), ("chili", "chilli"), ("collectible", "collectable"),
    ("cooperation", "co-operation"), ("coordination", "co-ordination"), ("czar", "tsar"), ("diaper", "nappy"), ("disc", "disk"), ("distill", "distil"),
    ("draft", "draught"), ("earmold", "earmould"), ("enquire", "inquire"), ("enquiry", "inquiry"), ("enroll", "enrol"), ("enrollment", "enrolment"),
    ("epaulet", "epaulette"), ("fagot", "faggot"), ("fiance", "fiancé"), ("fulfill", "fulfil"), ("furor", "furore"), ("gage", "gauge"), ("gasoline", "petrol"),
    ("negotiation", "negociation"), ("tranquility", "tranquillity"), ("willful", "wilful"), ("wilfully", "willfully"), ("fulfillment", "fulfilment"),
    ("entrust", "intrust"), ("instalment", "installment"), ("mustache", "moustache"), ("pajama", "pyjama"), ("pajamas", "pyjamas"), ("story", "storey"),
    ("stories", "storeys"), ("program", "programme"), ("programs", "programmes"), ("ton", "tonne"), ("tons", "tonnes"), ("specialty", "speciality"),
    ("cognizant", "cognisant"), ("tire", "tyre"), ("curb", "kerb"), ("check", "cheque"), ("jail", "gaol"), ("wagon", "waggon"), ("woolen", "woollen"),
    ("jewelry", "jewellery"), ("skillful", "skilful"), ("install", "instal"),
)


def american(word: Column) -> Column:
    """A word in lower case with the British spellings that a rule covers made American ones."""
    w = F.lower(F.trim(word))
    for pattern, by in BRITISH:
        w = F.regexp_replace(w, pattern, by.replace("\\", "$"))
    return w


def us_uk_key(a: Column, b: Column) -> Column:
    """The spellings as one key of a pair table, whichever comes first."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def us_uk_keys(pairs: Iterable[tuple[str, str]] = SPELLINGS) -> list[str]:
    return sorted({"|".join(sorted(x.lower() for x in p)) for p in pairs if p[0].lower() != p[1].lower()})


def is_us_uk(a: Column, b: Column, pairs: Iterable[tuple[str, str]] = SPELLINGS) -> Column:
    """A British and an American spelling of one word, by the rules or by a table of pairs.

    pairs is a parameter: a house list of any length takes the place of SPELLINGS. A
    long one is joined by us_uk_key instead. Nulls are no pair.
    """
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    found = (x != y) & ((american(a) == american(b)) | us_uk_key(a, b).isin(us_uk_keys(pairs)))
    return F.coalesce(found, F.lit(False))


def stems(word: Column) -> Column:
    """The forms under which a dictionary may hold a word; accents must be gone before.

    A possessive has its owner alone. Endings count from a length on; a doubled
    consonant before -ing and -ed may be single.
    """
    w = F.lower(F.trim(word))
    n = F.length(w)

    def cut(k: int, add: str = "") -> Column:
        return F.concat(F.substring(w, F.lit(1), F.greatest(n - k, F.lit(0))), F.lit(add))

    def single(k: int) -> Column:
        base = cut(k)
        return F.when((F.length(base) > 2) & (F.substring(base, -1, 1) == F.substring(base, -2, 1)), F.substring(base, F.lit(1), F.length(base) - 1))

    none = F.array().cast("array<string>")
    rules = [
        ((n > 5) & w.rlike("(ing|ed)ly$"), [cut(2), cut(4)]),
        ((n > 5) & w.endswith("ing"), [cut(3), single(3)]),
        ((n > 4) & w.endswith("ed"), [cut(2), single(2), cut(2, "e")]),
        ((n > 4) & w.endswith("ly"), [cut(2)]),
        ((n > 4) & w.endswith("er"), [cut(2)]),
        ((n > 4) & w.endswith("est"), [cut(3)]),
        ((n > 3) & w.endswith("s") & ~w.endswith("ss"), [cut(1)]),
        ((n > 4) & w.endswith("es"), [cut(2), cut(2, "y")]),
    ]
    found = F.flatten(F.array(F.array(w), *(F.when(test, F.array(*forms)).otherwise(none) for test, forms in rules)))
    owner = F.when(w.rlike("'s$|s'$"), F.array(w, cut(2))).when(w.endswith("'") & (n > 2), F.array(w, cut(1)))
    return F.array_distinct(F.filter(F.coalesce(owner, found), lambda x: x.isNotNull() & (x != "")))


# fixed value: letters with marks, and ligatures
MARKED = "[àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ\u0100-\u017f]"


def has_mark(word: Column) -> Column:
    """N30."""
    return F.lower(word).rlike(MARKED)

