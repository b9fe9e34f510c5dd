"""DataFrame-to-DataFrame operators. All are lazy unless their text says otherwise."""
