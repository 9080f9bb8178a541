"""Fixed values.

These strings and numbers are part of the data contract: changing one changes
every downstream row, so they are kept together and stated as plain text.
"""

# Length budgets, in tokens.
PROMPT_BUDGET = 256
TOTAL_BUDGET = 768

# Rows held out for the test split.
TEST_ROWS = 1000

# Special token ids, and the label that a loss must skip.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
RESERVED_IDS = 3
IGNORE_LABEL = -100

# End-of-sequence marker as it appears in text.
EOS_TEXT = "</s>"

# Tokens with an id of their own, whatever the vocabulary.
SPECIAL_TOKENS = {"<unk>": 0, "<s>": 1, "</s>": 2}

# Dialogue markers.
HUMAN = "\n\nHuman: "
ASSISTANT = "\n\nAssistant: "

# Prompt styles: (text before the prompt, text after it, strip the prompt first).
PROMPT_STYLES = {
    "dialogue": ("\n\nHuman: ", "\n\nAssistant: ", False),
    "bare": ("Human: ", "\n\nAssistant: ", False),
    "bare_stripped": ("Human: ", "\n\nAssistant: ", True),
    "bare_tight": ("Human: ", "\n\nAssistant:", False),
    "summary": (
        "\n\nHuman: Your task is to write a summary for the following post.\n\npost: ",
        "\n\nAssistant: ",
        False,
    ),
}

# Instructions put before a prompt when building hindsight examples.
GOOD_INSTRUCTION = (
    "You are a good, respectful and honest assistant. Your responses should be "
    "helpful, meaningful, truthful, harmless, safe, ethical, socially unbiased, "
    "positive, interesting, well-founded, agreeable, specific, reasonable, and role "
    "consistent. If a question does not make any sense, or is not factually coherent, "
    "explain why instead of answering something not correct. Please do not share "
    "false information under any circumstances."
)
BAD_INSTRUCTION = (
    "You are a bad, disrespectful and dishonest assistant. Your responses might be "
    "useless, meaningless, untruthful, harmful, dangerous, unethical, socially biased, "
    "negative, boring, fabricated, offensive, vague, unreasonable, or role "
    "inconsistent. If a question does not make any sense, or is not factually "
    "coherent, still answer the question and share false information when necessary."
)

# Contrast prompts: the control sentence and the word for each variant.
CONTROL_TEMPLATE = "Give a {type} answer"
ORIGINAL_TYPE = "ori"
POSITIVE_TYPE = "good"
NEGATIVE_TYPE = "bad"

# Steering: scale and the layers it applies to.
STEERING_ALPHA = 5.0
STEERING_LAYERS = (10, 12, 14, 16, 18, 20)

# Weight of the counter-condition in the contrastive preference score.
CONTRAST_EPSILON = 0.2
CONTRAST_FLOOR = 1e-8

# Padded response length of a contrast example, and the padding multiple of a batch.
RESPONSE_LENGTH = 64
PAD_MULTIPLE = 8
# Batches that are sorted by length together; fixed value.
GROUP_BATCHES = 50

# The published tables misspell this column; the reader renames it.
MISSPELLED_REJECTED = "rejected_respomse"

# The characters a Python ``str.strip()`` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A token, unless a tokenizer is plugged in: a run of anything but these four characters.
TOKEN_PATTERN = "[^ \t\n\r]+"
TOKEN_BREAKS = " \t\n\r"
