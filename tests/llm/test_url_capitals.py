import itertools

from crawlloom.llm import urlrules


def test_a_capital_is_a_separator():
    """Whatever a rule's expression matches, its tokens find."""
    rules = [*urlrules.PATTERNS, urlrules.Rule("block", pattern="/AdServer^"), urlrules.Rule("block", pattern="/Big/x^")]
    index = urlrules.RuleIndex(rules, {})
    parts = ["adserver", "AdServer", "about", "Big/x", "JS", "X", "x", "/", "."]
    for some in itertools.product(parts, repeat=3):
        path = "/" + "".join(some)
        want = [r.name for k, r in enumerate(rules) if index.regex[k].match("h.test" + path)]
        assert sorted(r.name for r in index.fitting("h.test", path)) == sorted(want)
    assert [r.name for r in index.fitting("h", "/adserverJS/x")] == ["/adserver^"]
    assert [r.name for r in index.fitting("h", "/Xabout/")] == ["^about^"]
