"""Analytics over rights-reservation evidence in image and text corpora, as DataFrame operators."""
