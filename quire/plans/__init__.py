"""Planning operators: image placement, classification, sampling and estimates."""
