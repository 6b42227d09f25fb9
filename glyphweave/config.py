"""Configuration of a text model: a flat, JSON-friendly record."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

GROUP, DELETE, NONE = "group", "delete", "none"


@dataclass(frozen=True)
class TextConfig:
    """What happens to a text on its way to a vector; see the functions that read each field."""

    # characters
    lc: bool = True
    del_diac: bool = True
    del_punc: bool = True
    del_dup: bool = False
    norm_emojis: bool = False
    disable_text_transformations: bool = False
    # kinds of words: none, group (replaced by a marker) or delete
    ent_option: str = NONE
    hashtag_option: str = NONE
    emo_option: str = NONE
    usr_option: str = GROUP
    url_option: str = GROUP
    num_option: str = GROUP
    # tokens: n > 0 character n-grams, n < 0 word n-grams, (n, s) skip-grams
    token_list: tuple = (-1,)
    q_grams_words: bool = False
    select_conn: bool = False
    select_suff: bool = False
    select_ent: bool = False
    # vocabulary and weights
    weighting: str = "tfidf"
    unit_vector: bool = True
    max_dimension: bool = False
    token_min_filter: float = 0
    token_max_filter: float = 1

    def __post_init__(self) -> None:
        object.__setattr__(self, "token_list", tuple(tuple(x) if isinstance(x, list | tuple) else int(x) for x in self.token_list))

    def _whole(self) -> list[int]:
        return [spec for spec in self.token_list if not isinstance(spec, tuple)]

    @property
    def ngrams(self) -> list[int]:
        return [-spec for spec in self._whole() if spec < 0]

    @property
    def qgrams(self) -> list[int]:
        return [spec for spec in self._whole() if spec > 0]

    @property
    def skipgrams(self) -> list[tuple[int, int]]:
        return [spec for spec in self.token_list if isinstance(spec, tuple)]

    def to_dict(self) -> dict:
        return asdict(self) | {"token_list": [list(x) if isinstance(x, tuple) else x for x in self.token_list]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, d: dict) -> TextConfig:
        """Unknown keys, such as the results of a search, are dropped."""
        own = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in d.items() if k in own})


def code(conf: dict) -> str:
    """A configuration's name: its settings in order of key, without the results."""
    return "-".join(f"{k}={conf[k]}" for k in sorted(conf) if not k.startswith("_"))


__all__ = ["DELETE", "GROUP", "NONE", "TextConfig", "code", "field"]
