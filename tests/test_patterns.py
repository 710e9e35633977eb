import pytest

from driftledger.functions.patterns import (
    PatternError,
    UnsupportedPattern,
    glob_to_java,
    regex_rule_to_java,
    regex_to_java,
    separators_normalized,
)
from driftledger.model import Rule
from driftledger.operators.rules import check_rules, compile_rules


def excluded(rows, rule, paths):
    compiled = compile_rules([rule])
    return rows(paths, lambda c: compiled.excludes(c))


@pytest.mark.parametrize(
    "rule, hit, miss",
    [
        (Rule("prefix", r"E:\Mess"), r"E:\Mess\a\b.o", r"E:\Messy\b.o"),
        (Rule("regex", r".*\\build\\.*"), r"E:\src\build\b.o", r"E:\src\builder\b.o"),
        (Rule("regex", r"E:\Mess\.*"), r"E:\Mess\b.o", r"E:\Meadow\b.o"),
        (
            Rule("regex", r"^E:\Tools\Zed\.Yak\.Xylophone"),
            r"E:\Tools\Zed.Yak.Xylophone_7\b.o",
            r"E:\Tools\Zed-Yak-Xylophone_7\b.o",
        ),
        # \d is a digit, so this never means the folder "dir"
        (Rule("regex", r"C:\dir\.*"), "C:7ir.", r"C:\dir\x"),
        # \h, \Q and \G are illegal in the dialect though Java has them: read as separators
        (Rule("regex", r"C:\hello"), r"C:\hello\x", r"C:ello"),
        (Rule("regex", r"C:\Quux"), r"c:\quux", r"C:uux"),
        (Rule("regex", r"C:\Games\Xray"), r"C:\games\XRAY\a", r"C:\Games\b"),
        # an own flag group switches the default off
        (Rule("regex", r"(?:noise)"), "c:/noise", "c:/NOISE"),
        (Rule("regex", r"(?-i)noise"), "c:/noise", "c:/NOISE"),
        (Rule("regex", r"É\d"), "é٣", "ex"),
        (Rule("regex", r"[[:digit:]]z$"), "a7z", "٣z"),
        (Rule("regex", r"a{2}+b"), "aaaab", "aaac"),
        (Rule("glob", r"**\$Recycle.Bin\**"), r"C:\$Recycle.Bin\x", r"C:\$recycle.bin\x"),
        (Rule("glob", "C:/Temp/*.log"), r"C:\Temp\deep\a.log", r"C:\Temp\a.logs"),
        (Rule("glob", "?:/[!a-c]*/**/x.{tmp,bak}"), r"C:\dir\x.bak", r"C:\bin\x.bak"),
    ],
)
def test_rule_hits_and_misses(rows, rule, hit, miss):
    assert excluded(rows, rule, [hit, miss]) == [True, False]


def test_separator_normalisation():
    assert separators_normalized(r"X:\Noise\.*") == "X:/Noise/.*"
    assert separators_normalized(r"a\.b\\c\*") == r"a\.b//c\*"
    assert separators_normalized("a\\") == "a/"


@pytest.mark.parametrize("bad", [r"\N", r"\U", r"\K", r"\h", r"\Q", r"\1", "(", ")", "*a", "a{3,1}", "(?=a)", "[a", "\\"])
def test_illegal_in_the_dialect(bad):
    with pytest.raises(PatternError):
        regex_to_java(bad)


def test_unsupported_is_not_a_fallback():
    with pytest.raises(UnsupportedPattern):
        regex_rule_to_java(r"(?U)\h")


def test_bad_rules_are_named(spark):
    with pytest.raises(PatternError, match=r"bad regex in rules: \(x"):
        compile_rules([Rule("regex", "(x")])
    with pytest.raises(PatternError, match="bad glob"):
        compile_rules([Rule("glob", "{a")])
    with pytest.raises(ValueError, match="is no kind of rule"):
        compile_rules([Rule("like", "a")])
    check_rules(spark, compile_rules([Rule("regex", r"C:\Noise\.*"), Rule("glob", "a*")]))
    with pytest.raises(PatternError):
        check_rules(spark, compile_rules([Rule("regex", r"\p{NoSuchScript}")]))


def test_prefix_boundaries_and_case(rows):
    paths = [r"C:\Noise", r"c:\noise/x", r"C:\noise\x", r"C:\noisy", "C:/Noise/x", r"D:\ÄB\x", r"D:\äb\x", ""]
    few = compile_rules([Rule("prefix", "c:/NOISE//"), Rule("prefix", r"d:\Äb"), Rule("prefix", "")])
    many = compile_rules([Rule("prefix", p) for p in ["c:/NOISE//", r"d:\Äb", *(f"q{n}" for n in range(60))]])
    want = [True, True, True, False, False, True, False, False]
    assert rows(paths, lambda c: few.excludes(c)) == want
    assert rows(paths, lambda c: many.excludes(c)) == want
    slash_root = compile_rules([Rule("prefix", "x:")])
    assert rows(["X:/a", "x:", "xy:"], lambda c: slash_root.excludes(c)) == [True, True, False]


def test_variables_and_nothing_configured():
    rules = [Rule("prefix", "${LOCALAPPDATA}\\Edge"), Rule("prefix", "%LOCALAPPDATA%\\B"), Rule("prefix", "${LOCALAPPDATA}")]
    assert compile_rules(rules, {"LOCALAPPDATA": "C:\\Me"}).prefixes == ("c:\\me", "c:\\me\\b", "c:\\me\\edge")
    assert compile_rules(rules).prefixes == ("\\b", "\\edge")
    assert glob_to_java("**") == r"(?s)\A.*\z"
