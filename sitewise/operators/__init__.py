"""DataFrame operators: frames in, frames out, column names as parameters."""
