"""Scalar building blocks: Column expressions first, Arrow UDFs where a state machine is needed."""
