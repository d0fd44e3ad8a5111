"""Line search: fixed match cases, printed form, and the dialect against RE2 itself."""

import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pyspark.sql import functions as F

from textquarry.functions.grams import gram_condition, required_literals
from textquarry.functions.patterns import compile_pattern
from textquarry.operators.grep import (
    format_matches,
    grep,
    grep_files,
    line_matches,
    search_summary,
    split_lines,
)

PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_{|}~"""
ESCAPED = "".join("\\" + c for c in PUNCTUATION)

# Pattern, text and the numbers of its matching lines.
CASES = [
    ("a+", "abc\ndef\nghi\n", [1]),
    ("^abcdefg", "abcdefg", [1]),
    ("a+", "baaab", [1]),
    ("abcd..", "abcdef", [1]),
    ("a", "a", [1]),
    ("x", "y", []),
    ("b", "abc", [1]),
    (".", "a", [1]),
    (".*", "abcdef", [1]),
    ("^", "abcde", [1]),
    ("$", "abcde", [1]),
    ("^abcd$", "abcd", [1]),
    ("^bcd'", "abcdef", []),
    ("^abcd$", "abcde", []),
    ("a*", "baaab", [1]),
    ("[a-z]+", "abcd", [1]),
    ("[^a-z]+", "ab1234cd", [1]),
    (r"[a\-\]z]+", "az]-bcz", [1]),
    (r"[^\n]+", "abcd\n", [1]),
    ("[日本語]+", "日本語日本語", [1]),
    ("日本語+", "日本語", [1]),
    ("日本語+", "日本語語語語", [1]),
    ("(a)", "a", [1]),
    ("(.)(.)", "日a", [1]),
    ("(.*)", "abcd", [1]),
    ("(..)(..)", "abcd", [1]),
    ("(([^xyz]*)(d))", "abcd", [1]),
    ("((a|b|c)*(d))", "abcd", [1]),
    ("(((a|b|c)*)(d))", "abcd", [1]),
    (r"\a\f\r\t\v", "\a\f\r\t\v", [1]),
    (r"[\a\f\n\r\t\v]+", "\a\f\r\t\v", [1]),
    ("a*(|(b))c*", "aacc", [1]),
    ("(.*).*", "ab", [1]),
    ("[.]", ".", [1]),
    ("/$", "/abc/", [1]),
    ("/$", "/abc", []),
    (".", "abc", [1]),
    ("(.)", "abc", [1]),
    (".(.)", "abcd", [1]),
    ("ab*", "abbaab", [1]),
    ("a(b*)", "abbaab", [1]),
    ("ab$", "cab", [1]),
    ("axxb$", "axxcb", []),
    ("data", "daXY data", [1]),
    ("da(.)a$", "daXY data", [1]),
    ("zx+", "zzx", [1]),
    ("ab$", "abcab", [1]),
    ("(aa)*$", "a", [1]),
    ("(?:A(?:A|a))", "Aa", [1]),
    ("(?:A|(?:A|a))", "a", [1]),
    (r"\b", "x", [1]),
    (r"\b", "xx", [1]),
    (r"\b", "x y", [1]),
    (r"\b", "xx yy", [1]),
    (r"\B", "x", []),
    (r"\B", "xx", [1]),
    (r"\B", "x y", []),
    (r"\B", "xx yy", [1]),
    ("(?im)^[abc]+$", "abcABC", [1]),
    ("(?im)^[α]+$", "αΑ", [1]),
    ("[Aa]BC", "abc", []),
    ("[Aa]bc", "abc", [1]),
    (r"[^\S\s]", "abcd", []),
    (r"[^\S[:space:]]", "abcd", []),
    (r"[^\D\d]", "abcd", []),
    (r"[^\D[:digit:]]", "abcd", []),
    (r"(?i)\W", "x", []),
    (r"(?i)\W", "k", []),
    (r"(?i)\W", "s", []),
    (ESCAPED, PUNCTUATION, [1]),
    (f"[{ESCAPED}]+", PUNCTUATION, [1]),
    (r"\`", "`", [1]),
    (r"[\`]+", "`", [1]),
    (".", "qwertyuiopasdfghjklzxcvbnm1234567890", [1]),
    # An empty text has no line, whatever the pattern.
    ("", "", []),
    ("()", "", []),
    ("(.*)", "", []),
    ("(a){0}", "", []),
    ("(?:.|(?:.a))", "", []),
    # Line ends, text anchors and folding, beyond the cases above.
    ("^$", "a\n\nb\n", [2]),
    ("^$", "abc\n", []),
    ("^$", "\n", [1]),
    ("a.b", "a\rb\na b\na\u0085b", [1, 2, 3]),
    ("b$", "ab\r\nab", [2]),
    (r"\Aab", "ab\nab", [1]),
    (r"ab\z", "ab\nab", [2]),
    (r"ab\z", "ab\nab\n", []),
    (r"\Aab\z|c", "ab\nc", [2]),
    (r"\Aab\z", "ab", [1]),
    (r"(?-m)^ab", "ab\nab", [1]),
    (r"\ba", "éa", [1]),
    (r"\s", "a\x0bb", []),
    ("[[:space:]]", "a\x0bb", [1]),
    ("(?i)i", "ı\nİ\nI", [3]),
    ("(?i)[a-z]", "ı\nİ\nK\nſ", [3, 4]),
    ("(?i)[^a-z]", "ı\nİ\nK\nſ\nx", [1, 2]),
    ("(?i)k", "K\nK\nk", [1, 2, 3]),
    ("a(?i)b|c(?-i)D", "aB\nCD\nCd\nAB", [1, 2]),
    (r"\Qa.b\E+", "a.bbb\naxb", [1]),
    ("x{,2}", "x{,2}\nxx", [1]),
    ("[[a]b", "[b\nab\nb", [1, 2]),
    ("[a&&b]", "&\nc", [1]),
    (r"\pL\p{^Greek}", "ab\n1α\naα", [1]),
    (r"[\p{Greek}0-9]x", "αx\n7x\nax", [1, 2]),
    (r"\x{1F600}|\101|\x41B", "😀\nA\nAB\nB", [1, 2, 3]),
    ("(?P<n_1>a)b", "ab", [1]),
    ("(?U)a+b", "aab", [1]),
]


@pytest.fixture(scope="module")
def case_docs(spark):
    rows = [(i, "input", text) for i, (_, text, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id int, name string, data string").coalesce(1).cache()
    docs.count()
    return docs


@pytest.mark.parametrize("engine", ["java", "re2"])
def test_match_cases(case_docs, engine):
    """All cases in one job: each line is tested with the pattern of its own case."""
    tests = []
    for i, (pattern, _, _) in enumerate(CASES):
        compiled = compile_pattern(pattern)
        hit = line_matches(compiled, engine)
        if engine == "java":
            hit = hit & F.col("data").rlike(compiled.text_regex)
        if engine == "java" or i % 5 == 0:
            tests.append(F.when(F.col("doc_id") == i, hit))
    lines = split_lines(case_docs, "data", ["doc_id", "data"])
    found = lines.where(F.coalesce(*tests)).select("doc_id", "line_no").collect()
    for i, (pattern, text, want) in enumerate(CASES):
        if engine == "java" or i % 5 == 0:
            assert sorted(r.line_no for r in found if r.doc_id == i) == want, (pattern, text)


def test_files_agree_with_lines(case_docs):
    for pattern in ["a+", "^$", r"\B", "b$", r"ab\z", r"[^a-z]", "(?i)k", r"\Aab", "x*", "(ab)+", "(a|b)+c"]:
        for engine in ("java", "re2"):
            files = {r.doc_id for r in grep_files(case_docs, pattern, engine=engine).collect()}
            lines = {r.doc_id for r in grep(case_docs, pattern, engine=engine).collect()}
            assert files == lines, (pattern, engine)


def test_printed_form(spark):
    docs = spark.createDataFrame(
        [(1, "input", "abc\ndef\nghalloo\n"), (2, "z.zip -> /input", "xay\nxa\ny\n")],
        "doc_id int, name string, data string",
    )

    def printed(pattern, **options):
        out = format_matches(grep(docs, pattern), **options)
        return [r.printed for r in out.orderBy("doc_id", "line_no").collect()]

    assert printed("a+", numbers=False)[:2] == ["input:abc", "input:ghalloo"]
    assert printed("x.*y") == ["z.zip -> /input:xay"]
    assert printed("x.*y", numbers=True) == ["z.zip -> /input:1:xay"]
    assert printed("gh", names=False, numbers=True) == ["3:ghalloo"]
    assert printed("gh", names=False) == ["ghalloo"]
    summary = search_summary(docs, grep(docs, "x")).first()
    assert (summary.candidates, summary.matched_files) == (2, 1)


@pytest.mark.parametrize("pattern", ["(", "a++", "a**", "(?=a)", r"\1", r"\Z", "[z-a]", r"\C", "a{2}{3}"])
def test_bad_patterns(pattern):
    with pytest.raises(ValueError):
        compile_pattern(pattern)


def test_engine_choice():
    linear = ["abc", "a?b{2,3}[cd]", "(?:ab|cd)?", "the (cat|dog) sat", r"\bword\b", "(a)b{4}"]
    unsafe = ["a*", "x.*y", "(ab)+", "(?:a?b?){20}", "a?a?a?a?a?a{5}", "[a-z]+=", "a{3,}"]
    assert [p for p in linear if compile_pattern(p).may_backtrack] == []
    assert [p for p in unsafe if not compile_pattern(p).may_backtrack] == []


def test_one_very_long_line(spark):
    """Minutes or hours for a backtracking engine; well under a second for a linear one."""
    line = "the ab " * 300_000
    docs = spark.createDataFrame([(1, "n", line + "\nthe zz")], "doc_id int, name string, data string")
    assert [r.line_no for r in grep(docs, "the.*zz").collect()] == [2]
    assert grep(docs, "(?:[a-z]+ )+zz").select("line_no").first().line_no == 2
    assert grep_files(docs, "b.*b.*zz").count() == 0


ATOMS = [
    "a", "b", "k", "S", "é", "ß", "日", ".", "[ab]", "[^a]", "[k-t]", "(?i:k)", "(?i:[^s])", r"\w", r"\W",
    r"\d", r"\D", r"\s", r"\S", r"\b", r"\B", "^", "$", "[[:alpha:]]", "[[:^digit:]k]", r"[^\W\d]", r"\.",
    r"\p{Lu}", r"[\PLx]", "(?i)s", "(?-i)S", "[é-ü]", "ab", r"\x{212A}", "(?i:ß)", "(?i:σ)", "",
]
LETTERS = list("abkKsSéÉßẞ日 .-_01σςΣKſ\r\t") + ["ab"]


def _random_pattern(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.5:
        return rng.choice(ATOMS)
    if kind < 0.7:
        return _random_pattern(rng, depth + 1) + _random_pattern(rng, depth + 1)
    if kind < 0.8:
        return f"(?:{_random_pattern(rng, depth + 1)}|{_random_pattern(rng, depth + 1)})"
    return f"(?:{_random_pattern(rng, depth + 1)}){rng.choice(['*', '+', '?', '{2}', '{1,2}', '+?'])}"


def _holds(condition, present):
    if isinstance(condition, bool):
        return condition
    if isinstance(condition, frozenset):
        return bool(condition & present)
    test = all if condition[0] == "and" else any
    return test(_holds(child, present) for child in condition[1])


def test_random_patterns_agree_with_re2(spark):
    """Java's verdict on a line equals RE2's, the text test never misses a matching
    line, and every matching text satisfies the trigram condition."""
    java = spark._jvm.java.util.regex.Pattern
    rng = random.Random(7)
    pruned = 0
    for _ in range(600):
        pattern, fold = _random_pattern(rng), rng.random() < 0.3
        try:
            compiled = compile_pattern(pattern, fold)
        except ValueError:
            continue
        lines = ["".join(rng.choices(LETTERS, k=rng.randint(0, 6))) for _ in range(8)]
        want = pc.match_substring_regex(pa.array(lines), pattern=pattern, ignore_case=fold).to_pylist()
        line_regex = java.compile(compiled.line_regex(True, True))
        text_regex = java.compile(compiled.text_regex)
        condition = gram_condition(compiled)
        pruned += condition is not True
        for line, hit in zip(lines, want, strict=True):
            assert line_regex.matcher(line).find() == hit, (pattern, fold, line)
            if hit:
                text = f"x\n{line}\ny"
                anchored = compiled.has_text_anchor
                assert line == "" or anchored or text_regex.matcher(text).find(), (pattern, line)
                grams = frozenset(line[i : i + 3] for i in range(len(line) - 2))
                assert _holds(condition, grams), (pattern, fold, line, condition)
                literals = required_literals(compiled)
                assert not literals or any(x in line for x in literals), (pattern, line, literals)
    assert pruned > 5


PIECES = [
    "abc", "bca", "ab", "c", "a+", "b?", "[ab]", "(?:ca)+", ".", "(?:abc|cab)", "(?:ab|c){2}", "b*",
    "(?:bb|a)?", "(?i:b)", "[^a]", "(?:abca){2,3}", "^", "$", "cb{2}a", "(?:a|bc|cab)",
]


def test_trigram_condition_never_loses_a_match():
    rng = random.Random(11)
    useful = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(PIECES, k=rng.randint(1, 4)))
        if rng.random() < 0.3:
            pattern = f"{pattern}|{''.join(rng.choices(PIECES, k=2))}"
        fold = rng.random() < 0.3
        condition = gram_condition(compile_pattern(pattern, fold))
        lines = ["".join(rng.choices("abcB", k=rng.randint(1, 14))) for _ in range(30)]
        hits = pc.match_substring_regex(pa.array(lines), pattern=pattern, ignore_case=fold).to_pylist()
        literals = required_literals(compile_pattern(pattern, fold))
        for line, hit in zip(lines, hits, strict=True):
            assert not (hit and literals) or any(x in line for x in literals), (pattern, line)
            holds = _holds(condition, frozenset(line[i : i + 3] for i in range(len(line) - 2)))
            assert holds or not hit, (pattern, fold, line, condition)
            useful += not holds
    assert useful > 10_000
