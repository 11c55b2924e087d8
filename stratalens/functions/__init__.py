"""Column expressions that several operators share."""

from stratalens.functions.text import can_contain, kind_of, text_form, typed_literal

__all__ = ["can_contain", "kind_of", "text_form", "typed_literal"]
