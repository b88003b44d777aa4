"""Token rows (F6–F9) with a stand-in tokenizer (F8).

The reference's BPE tokenizer and image tokens come with the model and are not rebuilt. Our
tokenizer is deterministic and JVM-side: whitespace tokens, each mapped to
``int(first 7 hex digits of md5(token), 16) % vocab + 2`` (ids 0 and 1 are pad and media).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow.constants import IGNORE_INDEX, MAX_LENGTH, MEDIA_ID, PAD_ID

SPLIT_PATTERN = "[ \t\n\r]+"
DEFAULT_VOCAB = 32000
# the rendered media parts (see chat.render_part): each is one token, the media id
MEDIA_PATTERN = r"<\|(image|video)\|>"
MEDIA_TOKENS = ("<|image|>", "<|video|>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """Whitespace tokens; a media marker is a token of its own even when glued to text."""
    t = F.coalesce(_c(text), F.lit(""))
    # the regex runs only on texts that can hold a marker
    spaced = F.when(t.contains("<|"), F.regexp_replace(t, MEDIA_PATTERN, " <|$1|> ")).otherwise(t)
    return F.filter(F.split(spaced, SPLIT_PATTERN), lambda w: w != "")


def token_ids(text, vocab: int = DEFAULT_VOCAB) -> Column:
    """F8: text → ``array<bigint>`` of stand-in ids over the whole text; a media marker maps
    to the media id (which :func:`mask_labels` masks, as the reference masks image tokens)."""
    return word_ids(words(text), vocab)


def word_ids(word_list, vocab: int = DEFAULT_VOCAB) -> Column:
    """F8 on the words of a text (:func:`words`): where only the first ids are kept, the words
    are cut first and the rest is never hashed."""
    return F.transform(_c(word_list), lambda w: F.when(
        w.isin(*MEDIA_TOKENS), F.lit(MEDIA_ID).cast("bigint")).otherwise(
        F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % F.lit(vocab) + F.lit(2)))


def pad_truncate(ids, n: int = MAX_LENGTH, pad: int = PAD_ID) -> Column:
    """keep the first ``n`` ids (max-length truncation), then right-pad to ``n``."""
    c = _c(ids)
    head = F.slice(c, 1, n)
    return F.concat(head, F.array_repeat(F.lit(pad).cast("bigint"),
                                         F.greatest(F.lit(n) - F.size(head), F.lit(0))))


def attention_mask(ids, pad: int = PAD_ID) -> Column:
    return F.transform(_c(ids), lambda i: F.when(i == pad, F.lit(0)).otherwise(F.lit(1)))


def attended(ids, pad: int = PAD_ID) -> Column:
    """Number of attended positions (the sum of :func:`attention_mask`) without a lambda:
    ``size(array_remove(ids, pad))`` runs inside generated code."""
    return F.size(F.array_remove(_c(ids), F.lit(pad).cast("bigint"))).cast("bigint")


def mask_labels(ids, pad: int = PAD_ID, media_ids=(MEDIA_ID,)) -> Column:
    """training labels = the ids with pad and media ids replaced by the ignore index.
    Prompt tokens are not masked (the reference's loss covers the whole text)."""
    masked = [pad, *media_ids]
    return F.transform(_c(ids), lambda i: F.when(i.isin(masked), F.lit(IGNORE_INDEX).cast("bigint"))
                       .otherwise(i))


def strip_prompt(generated, prompt_len, special=(PAD_ID, MEDIA_ID)) -> Column:
    """drop the first ``prompt_len`` ids of a generated sequence, then the special ids
    (``skip_special_tokens``)."""
    g = _c(generated)
    n = _c(prompt_len) if not isinstance(prompt_len, int) else F.lit(prompt_len)
    rest = F.when(F.size(g) > n, F.slice(g, n + 1, F.size(g) - n)) \
            .otherwise(F.array().cast("array<bigint>"))
    return F.filter(rest, lambda i: ~i.isin(list(special)))
