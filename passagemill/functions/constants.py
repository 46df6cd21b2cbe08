"""Fixed values. They decide results, so they are stated once, here."""

# Retrieval: fusion constant, candidates per arm, passages returned, share of documents above
# which a term no longer discriminates.
RRF_K = 60
CANDIDATES = 20
DEFAULT_TOP_K = 6
MAX_DOCUMENT_FRACTION = 0.5

# Request bounds.
MIN_QUERY_CHARS = 1
MAX_QUERY_CHARS = 500
MIN_TOP_K = 1
MAX_TOP_K = 20
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
MAX_RUN_EVENTS = 500
DEFAULT_WINDOW_DAYS = 30
TOP_QUERIES = 10

# Chunking, in tokens.
CHUNK_BUDGET = 500
CHUNK_OVERLAP = 60
CHUNK_MINIMUM = 80
MIN_CONTENT_SHARE = 0.25

# Embedding request limits.
MAX_INPUT_TOKENS = 8191
MAX_REQUEST_TOKENS = 300_000
MAX_BATCH_SIZE = 2048

# 32-bit FNV-1a.
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
FNV_MODULUS = 4294967296

# Full-text rank: weight of an unlabelled lexeme and the limit of the sum of 1/j^2.
LEXEME_WEIGHT = 0.1
INVERSE_SQUARE_LIMIT = 1.64493406685

# Answering.
DUPLICATE_OVERLAP = 0.8
MAX_SENTENCES = 4
MIN_SENTENCE_OVERLAP = 2
MIN_SENTENCE_CHARS = 20
NO_ANSWER = "NO_ANSWER"
ABSTENTION_TEXT = "I could not find an answer to this question in the corpus."
MIN_HIGHLIGHT_CHARS = 4
INFLECTIONS = "(?:s|es|ed|d|ing|ly)?"

# Caller limiter: requests per window.
RATE_LIMIT = 60
RATE_WINDOW_MS = 60_000

# Corpus folder scan.
CORPUS_EXTENSIONS = ("md", "markdown")
SKIPPED_NAMES = (".git", "node_modules", ".obsidian", ".DS_Store")

# Words that act as search operators and are never terms.
OPERATOR_WORDS = ("or", "and", "not")

# Words without topical signal for the extractive answers.
ANSWER_STOP_WORDS = (
    "a an and are as at be but by can do does for from get has have how i if in is it its of on or that the their "
    "them then there these this to was were what when where which who why will with you your must should about into "
    "after before every any"
).split()

# English stop words of PostgreSQL's full-text configuration.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

# Enumerations of the index and log tables.
DOCUMENT_STATUSES = ("PENDING", "INDEXED", "FAILED")
RUN_STATUSES = ("RUNNING", "COMPLETED", "FAILED")
EVENT_LEVELS = ("INFO", "WARN", "ERROR")

# Instructions sent with every numbered-source question.
SYSTEM_PROMPT = f"""Answer questions about a document corpus from the numbered sources below each question, and from nothing else.

1. Put the marker of the supporting source, such as [1] or [2][3], behind every factual sentence; leave out what no source supports.
2. Outside knowledge is not evidence, even when it is right.
3. Use only the given numbers, and name no document that is not listed.
4. When the sources do not hold the answer, reply with the single line
{NO_ANSWER}
and add no apology, guess or related material. A source on the same topic is not yet an answer.
5. When one of two disagreeing sources is deprecated, superseded or replaced, follow the current one and say which one it replaces.
6. When sources disagree and none is marked current, report each claim with its marker.
7. Be brief: a few sentences, or a list if one is asked for, without repeating the question or summing up."""
