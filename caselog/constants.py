"""Fixed values that results depend on."""

# Missing-value markers and padding.
MISSING_TEXT = "<NO_DESC>"
MISSING_NUMBER = -1
PAD_NUMBER = -1.0
PAD_WORD = 0

# Token of an `activity|key` pair, and the characters a word
# index treats as blanks (underscore and apostrophe belong to words).
PAIR_SEPARATOR = "|"
PAIR_TOKEN = r"[\p{L}\p{N}_]+\|[\p{L}\p{N}_]+"
WORD_BLANKS = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~\t\n'

# Size checks. A step that runs in one task, or comes to the driver, or is
# broadcast, does so only up to these sizes; beyond them another plan is used.
SMALL_ROWS = 100_000          # rows one task may order
CASE_ROWS = 2_000_000         # events of one case that one task may order
DENSE_WIDTH = 4_096           # slots of a dense one-hot block or wide table
BROADCAST_BYTES = 32 << 20    # bytes of a lookup table that may be broadcast, measured
HOT_SHARE = 1000              # a key of over this share of all rows is not gathered in one task
CHUNK_STEPS = 10_000          # steps of a case kept in one row
