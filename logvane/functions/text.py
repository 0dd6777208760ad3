"""Log-text cleaning, tokens, n-grams, templates and overlap measures as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop list (parts left of an apostrophe included).
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on",
    "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o", "re",
    "ve", "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn", "ma", "mightn", "mustn",
    "needn", "shan", "shouldn", "wasn", "weren", "won", "wouldn",
]
# Field names that carry no meaning in a log message.
DOMAIN_NOISE = [
    "rulename", "utctime", "processguid", "processid", "image", "targetprocessid", "targetprocessguid", "sourcename",
    "channel", "keywords", "opcodevalue", "severityvalue", "eventreceivedtime", "sourcemodulename", "sourcemoduletype",
    "version", "task", "threadid", "recordnumber", "executionprocessid", "providerguid", "timestamp", "none", "null",
    "true", "false",
]
# The cleaning patterns, applied in this order.
PATH_PATTERN = r"[A-Za-z]:\\(?:[^\s\r\n|,\\]+\\)*([^\s\r\n|,\\]+)"
GUID_PATTERN = r"\{[0-9a-fA-F\-]{8,}\}"
HEX_PATTERN = r"\b0x[0-9a-fA-F]+\b"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
EMPTY_DOCUMENT = "unknown_event"
MIN_WORD = 3


def clean_tokens(text: Column, stop_words: list[str] = STOP_WORDS, noise: list[str] = DOMAIN_NOISE) -> Column:
    """Meaningful lower-case words of a log text, in order.

    Paths keep their last part, GUIDs go, hex numbers become one word. Numbers
    and timestamps need no rule of their own: only letters are kept.
    """
    # (?U): blanks and word boundaries as Unicode defines them
    replaced = F.regexp_replace(text, "(?U)" + PATH_PATTERN, r" $1 ")
    replaced = F.regexp_replace(replaced, GUID_PATTERN, " ")
    replaced = F.regexp_replace(replaced, "(?U)" + HEX_PATTERN, " hexval ")
    # a text without these holds no path, GUID or hex number, and replacing makes none: what is left of a text stays as it was
    text = F.when(text.contains(":\\") | text.contains("{") | text.contains("0x"), replaced).otherwise(text)
    words = F.split(F.lower(F.regexp_replace(text, "[^a-zA-Z]+", " ")), " ")
    dropped = [w for w in dict.fromkeys([*stop_words, *noise]) if len(w) >= MIN_WORD]
    return F.filter(words, lambda w: (F.length(w) >= MIN_WORD) & ~w.isin(dropped))


def clean_text(text: Column, stop_words: list[str] = STOP_WORDS, noise: list[str] = DOMAIN_NOISE) -> Column:
    """The kept words joined by blanks, or a placeholder when none is left."""
    joined = F.array_join(clean_tokens(text, stop_words, noise), " ")
    return F.when(joined == "", F.lit(EMPTY_DOCUMENT)).otherwise(joined)


def bigrams(tokens: Column) -> Column:
    """Neighbouring words joined by a blank."""
    firsts = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.transform(firsts, lambda word, i: F.concat(word, F.lit(" "), F.get(tokens, i + 1)))


def terms(tokens: Column) -> Column:
    """Words and word pairs."""
    return F.concat(tokens, bigrams(tokens))


def event_corpus(columns: dict[str, Column]) -> Column:
    """Text of an event: message, both base names and the last part of the registry path."""
    target = F.lower(F.substring_index(columns["target_object"], "\\", -1))
    return F.concat_ws(" ", columns["message"], columns["image_base"], columns["target_image_base"], target)


def anomaly_context() -> Column:
    """One-line facts of an anomalous event for retrieval and analysis."""
    access = F.coalesce(F.col("granted_access"), F.lit(0))
    # absent text shows as the word a reader of the record would see
    shown = lambda name: F.coalesce(F.col(name), F.lit("None"))
    # The labels of the facts.
    parts = [
        ("EventID: ", F.col("event_id").cast("string")),
        ("Hostname: ", shown("hostname")),
        ("Process: ", shown("image")),
        ("TargetImage: ", shown("target_image")),
        ("TargetObject: ", shown("target_object")),
        ("Account: ", F.format_string("%s (%s)", shown("account_name"), shown("domain"))),
        ("GrantedAccess: ", F.when(access == 0, F.lit("N/A")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(access))))),
        ("IsolationForest score: ", F.format_string("%.4f", F.col("anomaly_score"))),
        ("Message: ", shown("message")),
    ]
    return F.concat_ws(" | ", *[F.concat(F.lit(name), value) for name, value in parts])


def question(event_id: Column, hostname: Column, keywords: Column) -> Column:
    # Fixed value: the sentence.
    return F.format_string(
        "Analyse this security anomaly: EventID %s on host %s. Topic keywords: %s.",
        event_id.cast("string"), hostname, F.coalesce(keywords, F.lit("")),
    )


def long_sentences(text: Column, longer_than: int = 20) -> Column:
    """Trimmed pieces between full stops that are longer than ``longer_than`` characters."""
    pieces = F.transform(F.split(text, r"\."), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(pieces, lambda s: F.length(s) > longer_than)


def grounding(analysis: Column, documents: Column, word_longer_than: int = 5) -> Column:
    """Share of long sentences with at least one long word that occurs in the documents; 0 without sentences."""
    documents = F.lower(F.coalesce(documents, F.lit("")))
    sentences = long_sentences(F.coalesce(analysis, F.lit("")))

    def grounded(sentence):
        words = F.split(F.lower(sentence), r"(?U)\s+")
        return F.exists(words, lambda w: (F.length(w) > word_longer_than) & documents.contains(w))

    hits = F.size(F.filter(sentences, grounded))
    return F.when(F.size(sentences) > 0, hits / F.size(sentences)).otherwise(F.lit(0.0))


def all_filled(columns: list[str]) -> Column:
    """1 when every named text column is present and not empty."""
    return reduce(Column.__and__, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]).cast("int")
