"""Production parameters that queries and the pipeline share."""

import public_tokenizers

TOKENIZER = {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
WORD_TOKENIZER = {"tokenizer_path": public_tokenizers.path("word_bpe_49k.json")}
