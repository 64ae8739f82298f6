"""A worker that goes from one operator to another gives back what the first one held."""

from lodestory.llm import shared


def test_other_operators_memory_is_given_back(monkeypatch):
    trimmed = []
    monkeypatch.setattr(shared, "trim", lambda: trimmed.append(1), raising=False)
    shared.own_cache("chunks")["encoder"] = "large"
    before = len(trimmed)
    shared.own_cache("language")
    shared.own_cache("language")
    assert len(trimmed) == before + 1
    assert not shared.own_cache("chunks")


def test_language_tasks_drop_other_caches():
    """Tasks that keep nothing themselves still serve as another operator."""
    import inspect

    from lodestory.llm import decontaminate, language_id, suffix_dedup

    for module in (decontaminate, language_id, suffix_dedup):
        assert "own_cache(" in inspect.getsource(module)
