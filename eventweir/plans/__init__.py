"""Rules, stages and plugins: how operators are put together into plans."""
