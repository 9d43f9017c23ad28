"""Shared by the kernel tests: what a text looks like once given parts of it are masked."""

from textweir.kernels import text as T


def masked(text: str, parts: list[str]) -> str:
    at = 0
    for part in parts:
        k = text.index(part, at)
        text = text[:k] + "*" * T.u16_length(part) + text[k + len(part) :]
        at = k + T.u16_length(part)
    return text


def check_censor(kernel, text: str, parts: list[str], *args) -> None:
    """Exactly ``parts`` are masked, the UTF-16 length stays, masking again changes nothing, check says whether anything is found."""
    once = T.censor(text, kernel.scan(text, *args))
    assert once == masked(text, parts), text
    assert T.u16_length(once) == T.u16_length(text)
    assert T.censor(once, kernel.scan(once, *args)) == once, text
    assert kernel.check(text, *args) == bool(parts), text
