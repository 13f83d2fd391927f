"""Inputs, payloads of services, and files that are written for people."""
