import pytest
from hypothesis import given
from hypothesis import strategies as st

from lineagrid.functions.lexing import DIALECTS, LexError, check_dialect, split, tokenize
from lineagrid.functions.positions import LineMap, byte_to_utf16, utf16_to_byte


def texts(source, dialect="postgres"):
    return [s.text for s in split(source, dialect)]


def test_statements_end_at_semicolons_and_at_the_end():
    assert texts("SELECT 1; SELECT 2") == ["SELECT 1", "SELECT 2"]
    assert texts(";;  ; -- only a comment") == []


def test_comments_stay_within_and_before_statements():
    found = split("-- one\n/* two */ SELECT -- in\n 1;\n-- tail", "postgres")
    assert [c for c, _ in found[0].comments] == ["-- one", "/* two */"]
    assert found[0].text == "SELECT -- in\n 1"
    assert len(found) == 1


def test_comment_after_a_semicolon_belongs_to_the_next_statement():
    assert [c for c, _ in split("A; -- note\nB;", "postgres")[1].comments] == ["-- note"]


@pytest.mark.parametrize("dialect, n", [("mysql", 1), ("postgres", 2), ("sqlite", 2)])
def test_hash_comments_are_mysql_only(dialect, n):
    assert len(split("SELECT 1 # a; b", dialect)) == n


def test_strings_hide_marks():
    assert texts("SELECT 'a;b*/''c'; X") == ["SELECT 'a;b*/''c'", "X"]
    assert texts(r"SELECT 'a\';b'; X", "mysql") == [r"SELECT 'a\';b'", "X"]


def test_dollar_quotes():
    assert texts("DO $$ a; b $$; DO $tag$ $$ ; $tag$; X") == ["DO $$ a; b $$", "DO $tag$ $$ ; $tag$", "X"]
    assert len(texts("SELECT $$a;b$$", "mysql")) == 2


@pytest.mark.parametrize("raw, value, dialect", [('"a""b"', 'a"b', "postgres"), ("`a``b`", "a`b", "mysql"), ("[a b]", "a b", "sqlite")])
def test_quoted_identifiers(raw, value, dialect):
    token = tokenize(raw, dialect)[0]
    assert (token.kind, token.value) == ("quoted", value)


@pytest.mark.parametrize(
    "source, dialect, message",
    [
        ("SELECT 'a", "postgres", "unterminated string literal starting at offset 7"),
        ("SELECT 'a''", "postgres", "unterminated string literal starting at offset 7"),
        ('x "a', "mysql", "unterminated quoted identifier starting at offset 2"),
        ("[a", "sqlite", "unterminated bracketed identifier starting at offset 0"),
        ("$a$ b", "postgres", "unterminated dollar-quoted string starting at offset 0"),
    ],
)
def test_unterminated(source, dialect, message):
    with pytest.raises(LexError, match=message.replace("$", r"\$")):
        split(source, dialect)


def test_block_comment_may_run_to_the_end():
    assert texts("A /* b; c") == ["A /* b; c"]


def test_trigger_bodies_are_cut_at_semicolons():
    assert len(texts("CREATE TRIGGER t BEGIN UPDATE x; END;", "sqlite")) == 2


def test_unknown_dialect():
    with pytest.raises(ValueError, match="expected postgres, mysql, or sqlite"):
        check_dialect("oracle")


@given(st.text(alphabet="aB1'\"`[]$;-/*# \n\\é", max_size=40), st.sampled_from(DIALECTS))
def test_offsets_point_into_the_source(text, dialect):
    source = text.encode().decode("latin-1")
    try:
        found = split(source, dialect)
    except LexError:
        return
    for s in found:
        assert source[s.start : s.end] == s.text
        for t in s.tokens:
            assert s.text[t.start : t.end] == t.raw or t.start < 0 or t.end > len(s.text)


def test_line_map():
    lines = LineMap("ab\n\ncd")
    assert [lines.locate(o) for o in (-5, 0, 2, 3, 4, 6)] == [(1, 1), (1, 1), (1, 3), (2, 1), (3, 1), (3, 3)]
    assert lines.offset(3, 2) == 5


def test_utf16_columns():
    line = "日本 😀 x".encode()
    assert byte_to_utf16(line, len("日本 ".encode())) == 3
    assert byte_to_utf16(line, len(line)) == 7
    assert utf16_to_byte(line, 5) == len("日本 😀".encode())
    assert utf16_to_byte(line, 4) == len("日本 ".encode())
