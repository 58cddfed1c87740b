"""Operations for large training corpora; nothing outside this folder imports it."""
