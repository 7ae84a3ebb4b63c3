from varloom.llm import token_output


def test_words_are_written_in_byte_letters_all_at_once():
    words = ["plain", " spaced", "Größe", " ÿþ", "­", "ɏ", "", " ", "naïve"]
    known = {ord(b): letter for b, letter in token_output._BYTE_LETTERS.items()}
    assert token_output._as_byte_letters(words) == [w.encode().decode("latin-1").translate(known) for w in words]
    assert token_output._as_byte_letters(["a", " b"]) == ["a", "Ġb"]
