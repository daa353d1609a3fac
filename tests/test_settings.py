"""Settings by dotted path, and the path guard."""

from leafmill.sources import settings as s


def test_changes_leave_the_original():
    base = {"tts": {"max": 3}}
    assert s.changed(base, "tts.voice", "v") == {"tts": {"max": 3, "voice": "v"}} and base == {"tts": {"max": 3}}
    assert s.changed(base, "a.b.c", 1)["a"] == {"b": {"c": 1}}
    assert s.reset(base, "tts.max") == {"tts": {}} and s.reset(base, "tts") == {} and s.reset(base, "x.y") == base


def test_coercion_keeps_the_current_value_on_failure():
    assert s.coerced(3, "4") == 4 and s.coerced(3, "x") == 3 and s.coerced(None, "x") == "x"


def test_path_guard():
    assert s.inside("/out", "b1/a.mp3") and not s.inside("/out", "../etc/x") and not s.inside("/out", "/etc/x") and not s.inside("/out", "")
