"""Fixed values that must equal the reference's for right results.

FIXED VALUES — class names per dataset, the few-shot exemplar id lists (in list order),
the prompt sentences, and the numeric settings (sequence length, batch sizes, frame count,
variance gate, generation limit). Do not edit them to make a test pass.
"""

from __future__ import annotations

# --- FIXED VALUES: class names; key 1 is the positive class, key 0 the negative one ---
LABEL_NAMES: dict[str, dict[int, str]] = {
    "hatemm": {0: "non-hateful", 1: "hateful"},
    "mhc": {0: "non-offensive", 1: "offensive"},
}

# --- FIXED VALUES: few-shot exemplar ids per dataset, in list order ---
EXEMPLAR_IDS: dict[str, list[str]] = {
    "hatemm": [
        "non_hate_video_1", "hate_video_67", "hate_video_131", "non_hate_video_276",
        "hate_video_226", "non_hate_video_350", "hate_video_307", "non_hate_video_418",
    ],
    "mhc": [
        "pQbEa24u-HM", "bONmkrUFgNs", "0BqXuLbTxks", "YLUQBKOOGHc",
        "uAEdVB7e4UM", "lUZDahwzuX4", "o0AzXXiIRNw", "PDIR3yEIS2M",
    ],
}

# --- FIXED VALUES: prompt sentences ({mode} is "image" or "video") ---
PROMPT_TEXT_OPEN = "Text: '"
PROMPT_TEXT_CLOSE = "' \n Analyze the "
PROMPT_QUESTION = " and text to determine if the content is "
PROMPT_RESPOND = ". Respond with '"
PROMPT_OR = "' or '"
PROMPT_ONE_WORD = "'—just one word, no sentences."
DEMO_OPEN = "Video with vision content: '"
DEMO_TEXT = "' and Text: '"
DEMO_TEXT_CLOSE = "'. \n Analyze the "
DEMO_ANSWER_SEP = " \n "
DEMO_CLOSING = " Video with vision content as shown and "

# --- FIXED VALUES: numeric settings ---
MAX_LENGTH = 512            # token row length (truncate + pad)
BATCH_SIZE = 4              # rows per device batch
GRAD_ACCUMULATION = 8       # batches per optimizer step
EPOCHS = 5
FRAMES_PER_VIDEO = 16       # evenly spaced frame sample
VARIANCE_THRESHOLD = 100.0  # grayscale population variance must be strictly greater
MAX_NEW_TOKENS = 25
IMAGE_SIDE_IMAGE_MODEL = 560
IMAGE_SIDE_VIDEO_MODEL = 224
IGNORE_INDEX = -100         # label value excluded from the loss
SHUFFLE_SEED = 42
FEW_SHOT_POOL = 8
DEFAULT_FEW_SHOT = 0

# Token ids reserved by our stand-in tokenizer (pad and media placeholder).
PAD_ID = 0
MEDIA_ID = 1
