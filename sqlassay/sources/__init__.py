"""Tables, eval cases, results and check streams in and out."""
