import pytest
from tokenizers import Tokenizer

from lodestory.llm.encoding import ChunkEncoder
from tests.llm.test_operators import BYTE, WORD

TEXTS = ["Plain words, and a word.", "it's IT'S we'll WE'LL. ','s a.'s don't!", "a.b,c;d:e!f?g", "x...y ?! .x", "tail.", ".head Words.", "1.5, 2,3 a1.b2", "Ünï. cödé, ÉTÉ!", "", None]


@pytest.mark.parametrize("path, spaces", [(WORD, False), (BYTE, True)])
def test_words_and_points_apart_give_the_librarys_ids(path, spaces):
    tok = Tokenizer.from_file(path)
    ids, n = ChunkEncoder(path, spaces).encode(TEXTS)
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_words_are_looked_up_once():
    enc = ChunkEncoder(WORD, False)
    enc.encode(["Word word, WORD. word! word; Word: word?"])
    assert sorted(enc.index) == sorted(["word", *",.!;:?"])
