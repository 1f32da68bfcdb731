"""Training-data operators: near duplicates, language, licences, mixing, tokens, quality, URLs, chat, media.

Nothing else in the package imports this subpackage.
"""
