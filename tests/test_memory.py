from pathlib import Path

from stratacloud import memory


def _write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_tightest_limit_of_all_groups_above(tmp_path):
    _write(tmp_path / "pod/box/memory.max", "max\n")
    _write(tmp_path / "pod/box/memory.high", "900\n")
    _write(tmp_path / "pod/memory.max", "700\n")
    _write(tmp_path / "memory.max", "800\n")
    _write(tmp_path / "other/memory.max", "5\n")
    assert memory.group_limit("0::/pod/box\n", tmp_path) == 700
    assert memory.group_limit("0::/not/seen/here\n", tmp_path) == 800


def test_first_version_and_no_limit(tmp_path):
    _write(tmp_path / "memory/a/memory.limit_in_bytes", f"{memory.UNLIMITED}\n")
    listing = "5:cpu,cpuacct:/a\n4:memory,hugetlb:/a\nnonsense\n"
    assert memory.group_limit(listing, tmp_path) is None
    _write(tmp_path / "memory/memory.limit_in_bytes", "1234")
    assert memory.group_limit(listing, tmp_path) == 1234


def test_detect(tmp_path, monkeypatch):
    _write(tmp_path / "list", "0::/\n")
    _write(tmp_path / "memory.max", "4096")
    assert memory.detect(tmp_path / "list", tmp_path) == 4096
    assert memory.detect(tmp_path / "none", tmp_path) == memory.machine_memory()
    monkeypatch.setattr(memory, "machine_memory", lambda: None)
    assert memory.detect(tmp_path / "none", tmp_path) == memory.DEFAULT_LIMIT
