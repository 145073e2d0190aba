import pytest

from chunkwise.sources import settings as st


def test_precedence_and_keys(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("chunk-size: 50\ntopK: 7\nstore-dir: /s\n")
    file = st.read(str(f))
    got = st.resolve({"chunk_size": 10}, {"top_k": 8}, {"CHUNKWISE_TOP_K": "9", "CHUNKWISE_ANALYZER": "english", "OTHER": "x"}, file)
    assert (got.chunk_size, got.top_k, got.analyzer, got.store_dir, got.candidates()) == (10, 8, "english", "/s", 24)
    assert st.merge({"top_k": 1, "store_dir": "/a"}, {"top_k": 2, "store_dir": "/b"}) == {"top_k": 2, "store_dir": "/a"}
    assert st.read(str(tmp_path / "none")) == {}
    f.write_text("odd: 1")
    with pytest.raises(ValueError):
        st.read(str(f))


def test_write_and_workspace(tmp_path):
    (tmp_path / st.FOLDER).mkdir()
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert st.workspace(str(deep)) == str(tmp_path / st.FOLDER) and st.workspace("/") is None
    path = str(tmp_path / st.FOLDER / "config.json")
    st.write(path, st.Settings(top_k=3, binary_extensions=("bin",)))
    assert st.read(path) == {"top_k": 3, "binary_extensions": ["bin"]} and st.resolve(file=st.read(path)).binary_extensions == ("bin",)
